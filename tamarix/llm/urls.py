"""Operator 9: url filters by rules, and by trust and distrust on the link graph of hosts.

Rules of (verdict, host, path) judge first; the longest that fits wins. Hosts of urls that an
allow rule fits seed a personalised PageRank along links; hosts of urls that a block rule fits
seed one along reversed links, so distrust reaches those who link to blocked hosts. Both start
from the share of a host's urls that the rules judged. A host whose distrust exceeds its trust
is blocked, and with it all its urls that no rule fits. Rounds go on until what a round changes,
summed over all hosts, is below TOLERANCE; all later rounds together then change less than
TOLERANCE * 0.85 / 0.15, which is below the 9 places compared. Everything is DataFrame operations;
the graph's state is a table of hosts, made durable every few rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarix.session import durable

DAMPING, TOLERANCE, DURABLE_EVERY = 0.85, 1e-10, 5
#: A table of hosts of at most so many bytes, as measured, is broadcast; rows of hosts of a larger one are dealt over so many parts.
BROADCAST_BYTES, PARTS = 16 << 20, 16
#: Rounds that the oracle writes out; it holds where links end within so many hosts.
ROUNDS = 10
#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (size, rule, verdict); null if none does. The rules are a literal, meant for some hundreds at most."""
    fits = []
    for verdict, h, p in rules:
        size = len(h) + len(p)
        made = F.struct(F.lit(size).alias("size"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        fits.append(F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), made))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def hosts_bytes(hosts: DataFrame, key: str = "host") -> int:
    """About the bytes of a table of hosts with a few numbers each."""
    return int(hosts.agg(F.sum(F.octet_length(key) + 64)).first()[0] or 0)


def beside(rows: DataFrame, hosts: DataFrame, key: str, size: int, how: str = "inner") -> DataFrame:
    """rows with what hosts (one row a key) says of their key. A hub's rows, however many, do not meet in one task: a table
    that was measured as small is broadcast, and of a larger one each host is repeated for every part of the rows."""
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(hosts), key, how)
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)), F.lit(PARTS)))
    everywhere = hosts.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    return dealt.join(everywhere, [key, "__part"], how).drop("__part")


def edges(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(a, b, share): links from host a to another host b, as shares of all such links of a."""
    links = F.regexp_extract_all(F.coalesce(F.col(f"`{html}`"), F.lit("")), F.lit(r"""(?i)href\s*=\s*["']?((?:https?:)?//[^"'\s>]*)"""), F.lit(1))
    found = pages.select(host_of(F.col(f"`{url}`")).alias("a"), F.explode(links).alias("link"))
    to = host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link")))
    counts = durable(found.select("a", to.alias("b")).where("a <> '' and b <> '' and a <> b").groupBy("a", "b").agg(F.count("*").alias("n")))
    total = durable(counts.groupBy("a").agg(F.sum("n").alias("total")))
    return beside(counts, total, "a", hosts_bytes(total, "a")).select("a", "b", (F.col("n") / F.col("total")).alias("share"))


def propagate(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, rank): seeds (host, seed) personalised along links (a, b, share), until the summed change of a round is below the tolerance."""
    size = hosts_bytes(seeds) + hosts_bytes(links.select(F.col("b").alias("host")).distinct())
    base = seeds.select("host", (F.lit(1 - damping) * F.col("seed")).alias("part"), F.lit(0.0).alias("moved"))
    state = base.select("host", F.col("part").alias("rank"), F.col("part").alias("change"))
    while True:
        for _ in range(DURABLE_EVERY):
            weight = F.lit(damping) * F.col("share")
            sent = beside(links, state.withColumnRenamed("host", "a"), "a", size).select(F.col("b").alias("host"), (weight * F.col("rank")).alias("part"), (weight * F.col("change")).alias("moved"))
            state = base.unionByName(sent).groupBy("host").agg(F.sum("part").alias("rank"), F.sum("moved").alias("change"))
        state = durable(state)
        if (state.agg(F.sum("change")).first()[0] or 0.0) < tolerance:
            return state.select("host", "rank")


def judge(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url", html: str = "html", tolerance: float = TOLERANCE) -> DataFrame:
    """page_id, host, path, rule and verdict of each url. Urls without a host get the verdict allow unless a rule fits. Repeated rows each keep their row;
    other columns are not carried on; a null page is one without links; an empty table gives an empty table."""
    address = F.col(f"`{url}`")
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), host_of(address).alias("host"), path_of(address).alias("path"))
    rows = rows.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    counted = rows.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("r.verdict") == "allow").alias("good"), F.count_if(F.col("r.verdict") == "block").alias("bad"))
    hosts = durable(counted.where("host <> ''"))
    forward = durable(edges(pages, url, html))
    total = durable(forward.groupBy("b").agg(F.sum("share").alias("total")))
    backward = beside(forward, total, "b", hosts_bytes(total, "b")).select(F.col("b").alias("a"), F.col("a").alias("b"), (F.col("share") / F.col("total")).alias("share"))
    trust = propagate(hosts.select("host", (F.col("good") / F.col("n")).alias("seed")), forward, tolerance=tolerance)
    distrust = propagate(hosts.select("host", (F.col("bad") / F.col("n")).alias("seed")), backward, tolerance=tolerance)
    both = trust.select("host", "rank", F.lit(0.0).alias("against")).unionByName(distrust.select("host", F.lit(0.0).alias("rank"), F.col("rank").alias("against")))
    blocked = both.groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("against").alias("against")).where("round(against, 9) > round(rank, 9)")
    blocked = durable(blocked.select("host", F.lit(True).alias("blocked")))
    marked = beside(rows, blocked, "host", hosts_bytes(blocked), "left")
    by_host = F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return marked.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), by_host).alias("verdict"))


def oracle(rounds: int = ROUNDS, damping: float = DAMPING, rules=RULES) -> str:
    """The same in SQL, with the rounds written out."""
    fits = " UNION ALL ".join(f"SELECT '{v}' AS verdict, '{h}' AS h, '{p}' AS p" for v, h, p in rules)
    lower = f"translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}')"
    parts = [
        f"rules AS ({fits})",
        f"u AS (SELECT page_id, coalesce({lower}, '') AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path, html FROM pages)",
        "fit AS (SELECT page_id, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS k FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))",
        "r AS (SELECT u.page_id, u.host, u.path, fit.rule, fit.verdict FROM u LEFT JOIN fit ON fit.page_id = u.page_id AND fit.k = 1)",
        "hosts AS (SELECT host, count(*) FILTER (WHERE verdict = 'allow') / count(*) AS good, count(*) FILTER (WHERE verdict = 'block') / count(*) AS bad FROM r WHERE host <> '' GROUP BY host)",
        """links AS (SELECT host AS a, unnest(regexp_extract_all(coalesce(html, ''), '(?i)href\\s*=\\s*["'']?((?:https?:)?//[^"''\\s>]*)', 1)) AS link FROM u)""",
        f"pairs AS (SELECT a, translate(regexp_extract(link, '^.*?//([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS b FROM links)",
        "e AS (SELECT a, b, count(*) AS n FROM pairs WHERE a <> '' AND b <> '' AND a <> b GROUP BY a, b)",
        "fwd AS (SELECT e.a, e.b, n / total AS share FROM e JOIN (SELECT a, sum(n) AS total FROM e GROUP BY a) t ON t.a = e.a)",
        "bwd AS (SELECT fwd.b AS a, fwd.a AS b, share / total AS share FROM fwd JOIN (SELECT b, sum(share) AS total FROM fwd GROUP BY b) t ON t.b = fwd.b)",
    ]
    for name, seed, links in (("t", "good", "fwd"), ("d", "bad", "bwd")):
        parts.append(f"{name}0 AS (SELECT host, {seed} AS rank FROM hosts)")
        for i in range(rounds):
            parts.append(f"{name}{i + 1} AS (SELECT host, sum(part) AS rank FROM (SELECT host, {1 - damping} * {seed} AS part FROM hosts UNION ALL SELECT l.b AS host, {damping} * share * rank AS part FROM {links} l JOIN {name}{i} s ON s.host = l.a) x GROUP BY host)")
    parts.append(f"bad AS (SELECT d.host FROM d{rounds} d LEFT JOIN t{rounds} t ON t.host = d.host WHERE round(d.rank, 9) > round(coalesce(t.rank, 0), 9))")
    return "WITH " + ",\n".join(parts) + "\nSELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM r"

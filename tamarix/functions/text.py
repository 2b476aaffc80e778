"""Text operators: HTML to text, chunks with offsets, tokens with offsets, context around a span."""

from __future__ import annotations

import itertools
import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The tags whose text is no text of a page.
IGNORED_TAGS = ("style", "link", "script", "head", "meta")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Texts(HTMLParser):
    def __init__(self, ignored, ancestors):
        super().__init__(convert_charrefs=True)
        self.open, self.texts, self.ignored, self.ancestors = [], [], frozenset(ignored), ancestors

    def handle_starttag(self, tag, attrs):
        if tag not in _VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        within = self.open if self.ancestors else self.open[-1:]
        if data.strip() and not self.ignored.intersection(within):
            self.texts.append(data)


def html_texts(html: str | None, ignored=IGNORED_TAGS, ancestors: bool = True) -> list[str] | None:
    """The text runs of a page that no ignored tag encloses (or, with ancestors=False, directly holds). Doctypes, comments and unclosed tags are taken as they come."""
    if html is None:
        return None
    parser = _Texts(ignored, ancestors)
    parser.feed(html)
    parser.close()
    return parser.texts


def extract_html(df: DataFrame, column: str = "html", out: str = "texts", ignored=IGNORED_TAGS, ancestors: bool = True) -> DataFrame:
    @F.pandas_udf("array<string>")
    def extract(pages):
        return pages.map(lambda x: html_texts(x, ignored, ancestors))

    return df.withColumn(out, extract(F.col(column)))


_BREAK = re.compile(r"^(?:#{1,6} |\||```)", re.M)


def chunk_text(text: str, most: int = 200) -> list[tuple[int, int, str]]:
    """(start, end, chunk) of at most so many words; headings, tables and code fences begin a new one."""
    breaks = {m.start() for m in _BREAK.finditer(text)}
    out, begin, end, count = [], None, 0, 0
    for m in re.finditer(r"\S+", text):
        if begin is not None and (count >= most or m.start() in breaks):
            out.append((begin, end, text[begin:end]))
            begin, count = None, 0
        if begin is None:
            begin = m.start()
        end, count = m.end(), count + 1
    if begin is not None:
        out.append((begin, end, text[begin:end]))
    return out


def chunks(df: DataFrame, column: str = "text", most: int = 200) -> DataFrame:
    """df with one row per chunk: chunk_no, chunk_start, chunk_end, chunk (offsets in code points)."""

    @F.pandas_udf("array<struct<chunk_start:int,chunk_end:int,chunk:string>>")
    def split(texts):
        return texts.map(lambda t: [dict(zip(("chunk_start", "chunk_end", "chunk"), c)) for c in chunk_text(t, most)] if t is not None else None)

    made = df.withColumn("__chunks", split(F.col(column))).select(*df.columns, F.posexplode("__chunks").alias("chunk_no", "__c"))
    return made.select(*df.columns, "chunk_no", "__c.*")


_WORD = re.compile(r"[0-9A-Za-z_]+|[^0-9A-Za-z_ \t\n\x0b\f\r]")


#: Tokens that are handed on at a time, and bytes of text that are read at a time.
TOKENS_AT_A_TIME, BYTES_AT_A_TIME = 1 << 15, 1 << 20


def tokens(df: DataFrame, column: str = "text", most: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """df, or only its columns named in keep, with one row per word or mark: token_no, token, token_start, token_end (code points); with most, the first so many of a text, as a model's longest input asks for.

    Tokens leave Python in runs of a bounded number, so neither many nor long texts are held as tokens at once."""
    import pyarrow as pa

    kept = df.columns if keep is None else keep
    shown = df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{column}`").alias("__text"))
    run_type = pa.list_(pa.struct([("token", pa.string()), ("token_start", pa.int32()), ("token_end", pa.int32())]))

    def split(batches):
        for batch in batches:
            step = max(1, batch.num_rows * BYTES_AT_A_TIME // max(batch.nbytes, 1))
            for begin in range(0, batch.num_rows, step):
                yield from runs(batch.slice(begin, step))

    def runs(batch):
        """Batches of the kept columns, the number of a run's first token, and the run."""
        rows, bases, ends, words, starts, stops = [], [], [0], [], [], []

        def made():
            parts = [pa.array(words, pa.string()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(run_type.value_type)))
            taken = [x.take(pa.array(rows, pa.int64())) for x in batch.columns[:-1]]
            out = pa.RecordBatch.from_arrays([*taken, pa.array(bases, pa.int32()), lists], names=[*kept, "__base", "__run"])
            for held in (rows, bases, words, starts, stops):
                held.clear()
            ends[:] = [0]
            return out

        for row in range(batch.num_rows):
            text = batch.column(len(kept))[row].as_py()
            found = itertools.islice(_WORD.finditer(text), most) if text is not None else iter(())
            base = 0
            while part := list(itertools.islice(found, TOKENS_AT_A_TIME - len(words))):
                words.extend(m[0] for m in part)
                starts.extend(m.start() for m in part)
                stops.extend(m.end() for m in part)
                rows.append(row)
                bases.append(base)
                ends.append(len(words))
                base += len(part)
                if len(words) == TOKENS_AT_A_TIME:
                    yield made()
        if rows:
            yield made()

    schema = T.StructType([*shown.schema.fields[:-1], *T._parse_datatype_string("__base int, __run array<struct<token:string,token_start:int,token_end:int>>").fields])
    kept_now = [F.col(f"`{c}`") for c in kept]
    out = shown.mapInArrow(split, schema).select(*kept_now, "__base", F.posexplode("__run").alias("__at", "__t"))
    return out.select(*kept_now, (F.col("__base") + F.col("__at")).alias("token_no"), "__t.*")


def with_context(text: Column, start: Column, end: Column, around: int = 300) -> Column:
    """The text from `around` characters before start to `around` after end, within its bounds."""
    begin = F.greatest(start - around, F.lit(0))
    stop = F.least(end + around, F.length(text))
    return F.substring(text, begin + 1, stop - begin)

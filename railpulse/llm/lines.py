"""Line dedup: a log-template tree whose recurring templates are dropped."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railpulse.llm.common import Texts, WordHash, byte_class, mixed, stage, texts_of

# Leading tokens that lead to a leaf, and pieces into which the tokens after them are cut.
DEPTH, PIECES = 8, 8
# Documents in which a short template must occur to be dropped, and a long one.
MIN_DOCS, LONG_DOCS = 5, 2
# A long template has so many tokens, and so many of the leading ones are no fields.
LONG_TOKENS, LONG_WORDS = 9, 6

BREAK = 0x0A
TOKEN = ~byte_class((0x20, 0x20), (0x09, 0x0D))
DIGIT = byte_class((0x30, 0x39))
LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
FIELD = np.uint64(0x5851F42D4C957F2D)  # stands for every token with a digit
LAST = (1 << 63) - 1


def _counts(flags: np.ndarray) -> np.ndarray:
    counts = np.zeros(len(flags) + 1, dtype=np.int32)
    np.cumsum(flags, out=counts[1:])
    return counts


def parsed(t: Texts, h: WordHash, depth: int = DEPTH) -> dict[str, np.ndarray]:
    """The lines of some texts that can be templates, as arrays.

    ``text`` and ``at`` say where a line is, ``leaf`` stands for its number of tokens and
    the first ``depth`` of them, ``line`` for all, ``pieces`` (of which the line has
    ``parts``) for consecutive runs of the rest, each with its leaf and place.
    """
    starts, ends, doc = t.words(TOKEN)
    breaks = _counts(t.data == BREAK)
    line = breaks[starts] + doc  # texts end a line, too
    digits, letters = _counts(DIGIT[t.data]), _counts(LETTER[t.data])
    field = digits[ends] > digits[starts]
    tokens = h.words(t.data, starts, ends)
    tokens[field] = FIELD
    worded = ~field & (letters[ends] > letters[starts])
    first = np.flatnonzero(np.diff(line, prepend=-1))
    n = np.diff(np.append(first, len(line)))
    kept = np.add.reduceat(worded, first) > 0 if len(first) else np.zeros(0, dtype=bool)
    first, n = first[kept], n[kept]

    def run(begin: np.ndarray, end: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return mixed(mixed(h.sequence.slices(tokens, begin, end) + (end - begin).astype(np.uint64)) + salt.astype(np.uint64))

    head = first + np.minimum(n, depth)
    leaf = run(first, head, n)
    plain = _counts(~field)
    width = -(-(n - depth) // PIECES)
    parts = np.where(n > depth, -(-(n - depth) // np.maximum(width, 1)), 0)
    owner = np.repeat(np.arange(len(n)), parts)
    i = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = first[owner] + depth + i * width[owner]
    end = np.minimum(begin + width[owner], first[owner] + n[owner])
    return {
        "text": doc[first],
        "at": line[first] - breaks[t.offsets[doc[first]]] - doc[first],
        "leaf": leaf,
        "line": run(first, first + n, leaf),
        "long": (n >= LONG_TOKENS) & (plain[head] - plain[first] >= LONG_WORDS),
        "parts": parts,
        "pieces": run(begin, end, mixed(leaf[owner] + (i + 1).astype(np.uint64))),
    }


def document() -> tuple[Column, Column]:
    """What tells documents apart: the doc_id, the largest one for NULL, and for NULL a number by text, else 0."""
    number = F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long") + 1
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), F.when(F.col("doc_id").isNull(), number).otherwise(0)


LINES = "doc long, anon long, content long, at int, leaf long, line long, `long` boolean, pieces array<long>"


def parsed_lines(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """A row per line that can be a template; see :func:`parsed`.

    Tokens with a digit are variable fields. A line of fields and marks only, or a
    blank one, is no template. All lines of a leaf are ``long``, or none is.
    """
    names = [c.split()[0].strip("`") for c in LINES.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = WordHash(7)
        for batch in batches:
            for t in texts_of(batch.column(3)):
                p = parsed(t, h, depth)
                rows = pa.array(p["text"] + t.first)
                pieces = pa.ListArray.from_arrays(pa.array(_counts(p["parts"]), pa.int32()), pa.array(p["pieces"].view(np.int64)))
                columns = [batch.column(i).take(rows) for i in range(3)]
                columns += [pa.array(p["at"], pa.int32()), *(pa.array(p[c].view(np.int64)) for c in ("leaf", "line")), pa.array(p["long"]), pieces]
                yield pa.RecordBatch.from_arrays(columns, names)

    doc, anon = document()
    rows = docs.select(doc.alias("doc"), anon.alias("anon"), F.xxhash64("text").alias("content"), F.col("text").cast("binary").alias("text"))
    return rows.where("text is not null").mapInArrow(scan, LINES)


def _frequent(rows: DataFrame, key: str, whole: str, min_docs: int, long_docs: int) -> DataFrame:
    """Keys in enough documents: (_key, _doc, _anon, _differ), with the first document that
    has it, and whether its rows differ in ``whole``.

    Documents are counted by partial sums, so no task sees all lines of a frequent template.
    """
    docs = rows.groupBy(key, "long", "doc", "anon").agg(F.min(whole).alias("_low"), F.max(whole).alias("_high"))
    found = docs.groupBy(key, "long").agg(
        F.count(F.lit(1)).alias("docs"), F.min(F.struct("doc", "anon")).alias("first"), F.min("_low").alias("_low"), F.max("_high").alias("_high")
    )
    enough = F.col("docs") >= F.when(F.col("long"), long_docs).otherwise(min_docs)
    differ = (F.col("_low") != F.col("_high")).alias("_differ")
    return found.where(enough).select(F.col(key).alias("_key"), F.col("first.doc").alias("_doc"), F.col("first.anon").alias("_anon"), differ)


LATER = "doc <> _doc or anon <> _anon"


def recurring_lines(lines: DataFrame, min_docs: int = MIN_DOCS, long_docs: int = LONG_DOCS) -> DataFrame:
    """Lines to drop, (doc, anon, content, at): those of which at least half of the pieces recur.

    A piece recurs if enough documents have it at its place in a line of the leaf,
    and one of them is earlier. Whatever else a leaf holds plays no part, so an odd
    line keeps only itself out, and several templates may share a leaf. A line without
    tokens after the leading ones is a piece by itself. Most leaves have one line in all
    documents, which then recurs whole; only the others' pieces are counted. Frequent
    keys are spread by the adaptive skew join. The joins are merge joins at every size, so
    that the plan does not change as the table grows.
    """
    where = ["doc", "anon", "content", "at"]
    leaves = stage(_frequent(lines, "leaf", "line", min_docs, long_docs), "line-leaves")
    found = lines.hint("merge").join(leaves, F.col("leaf") == F.col("_key"))
    found = found.select(*where, "long", "pieces", (~F.col("_differ") & F.expr(LATER)).alias("gone"), "_differ").where("gone or _differ")
    found = stage(found, "line-found")
    parts = found.where("_differ").select(*where, "long", F.size("pieces").alias("parts"), F.posexplode("pieces").alias("i", "piece"))
    seen = stage(_frequent(parts, "piece", "i", min_docs, long_docs), "line-pieces")
    again = parts.hint("merge").join(seen, F.col("piece") == F.col("_key")).where(LATER)
    # Bits, since repeated rows have their pieces more than once.
    again = again.groupBy(*where, "parts").agg(F.bit_or(F.expr("shiftleft(1, i)")).alias("again"))
    gone = again.where(2 * F.bit_count("again") >= F.col("parts")).select(*where)
    return found.where("gone").select(*where).union(gone)


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH, long_docs: int = LONG_DOCS) -> DataFrame:
    """The documents without lines whose template recurs across documents.

    The document with the smallest doc_id (NULL last) that has a piece of a template
    keeps it, unless half of its line recurs from earlier ones. The text loses the
    dropped lines; blank lines and lines without letters stay. ``_ld_lines`` counts all
    lines and ``_ld_dropped`` the dropped ones; other columns pass unread, whatever
    their names.

    A NULL text has no lines and stays NULL; an empty one has one blank line. Rows
    with one doc_id count as one document, those without it by 60 bits of their text's
    MD5, in that order. Order among ties plays no part. Templates and pieces are 64-bit
    hashes: of a million different pieces at one place of a leaf two are taken for
    equal with a probability of 3e-8.
    """
    lines = stage(parsed_lines(docs, depth), "lines")
    key = ["doc", "anon", "content"]
    gone = recurring_lines(lines, min_docs, long_docs).groupBy(*key).agg(F.collect_set("at").alias("_ld_gone"))
    gone = stage(gone.select(*[F.col(c).alias(f"_ld_{c}") for c in key], "_ld_gone"), "line-drops")
    doc, anon = document()
    same = (doc == F.col("_ld_doc")) & (anon == F.col("_ld_anon")) & (F.xxhash64("text") == F.col("_ld_content"))
    joined = docs.hint("merge").join(gone, same, "left").select(*docs.columns, "_ld_gone")
    columns, at = docs.columns, docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, gone = batch.column(at), batch.column(len(columns))
            total = pc.fill_null(pc.add(pc.count_substring(text, "\n"), 1), 0).cast(pa.int64())
            some = gone.is_valid()
            texts = []
            for old, numbers in zip(text.filter(some), gone.filter(some)):
                out = set(numbers.as_py())
                texts.append(b"\n".join(x for i, x in enumerate(old.as_py().split(b"\n")) if i not in out))
            text = pc.replace_with_mask(text, some, pa.array(texts, text.type))
            dropped = pc.fill_null(pc.list_value_length(gone), 0).cast(pa.int64())
            rest = [text if i == at else c for i, c in enumerate(batch.columns[: len(columns)])]
            yield pa.RecordBatch.from_arrays([*rest, total, dropped], [*columns, "_ld_lines", "_ld_dropped"])

    binary = joined.withColumn("text", F.col("text").cast("binary"))
    types = ", ".join(f"`{c}` {t}" for c, t in binary.dtypes[: len(columns)])
    return binary.mapInArrow(cut, f"{types}, _ld_lines long, _ld_dropped long").withColumn("text", F.col("text").cast("string"))


def without_recurring_lines(docs: DataFrame) -> DataFrame:
    """The documents, cleaned, with their own columns; those that lose all their text go."""
    d = drop_recurring_lines(docs).where((F.col("_ld_dropped") == 0) | F.col("text").rlike(r"\S"))
    n_chars = [F.when(F.col("_ld_dropped") == 0, F.col("n_chars")).otherwise(F.length("text")).alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns]
    return d.select(*n_chars)


def report(docs: DataFrame) -> DataFrame:
    """Per document: number of lines, of dropped lines, and a digest of the kept text."""
    return drop_recurring_lines(docs.select("doc_id", "text")).select(
        "doc_id",
        F.col("_ld_lines").alias("n_lines"),
        F.col("_ld_dropped").alias("n_dropped"),
        F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"),
    )

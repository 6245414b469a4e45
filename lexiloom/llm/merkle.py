"""Document fingerprints: Merkle trees over sections, paragraphs and pieces of text."""

from __future__ import annotations

import functools
import hashlib
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiloom.llm.substring_dedup import Chunking, cut_points
from lexiloom.session import ship_package

LONGEST = 64  # bytes of a word that are a piece as they are; the text cuts longer ones itself
LEAF = 3  # characters of a piece in the fingerprint, 18 bits of its digest
PIECE = re.compile(rb"[^ ]* |[^ ]+")
WITHIN = Chunking(window=4, reach=8, largest=LONGEST)
KEPT = 4096  # lines of fewer bytes are looked up where an edited text repeats them
# The 64 characters that write a leaf, and the mark for the two ends of a paragraph.
SIGNS = np.frombuffer((string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_").encode(), np.uint8)
END = "$" * LEAF
_VALUE = np.full(256, 64, np.int64)
_VALUE[SIGNS] = np.arange(64)


def _hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _pieces(paragraph: bytes) -> list[bytes]:
    """Cuts a paragraph after every space, and words of over ``LONGEST`` bytes, as in texts without spaces, where a
    rolling hash of their bytes says so. An edit moves no cut but those beside it, and the rule is one for all
    lengths, so texts of any two sizes are comparable. The pieces put together are the paragraph."""
    out = []
    for piece in PIECE.findall(paragraph):
        if len(piece) <= LONGEST:
            out.append(piece)
        else:
            ends = cut_points(piece, WITHIN)
            out += [piece[a:b] for a, b in zip([0, *ends], ends)]
    return out or [b""]


def _paragraph(line: bytes) -> tuple[bytes, str]:
    """A paragraph's node, and what the fingerprint shows of its pieces."""
    leaves = b"".join([_hash(p) for p in _pieces(line)])
    head = np.frombuffer(leaves, np.uint8).reshape(-1, 16)[:, :3].astype(np.int64) @ np.array([65536, 256, 1])
    return _hash(b"p" + leaves), SIGNS[np.stack([head >> 18, head >> 12, head >> 6], 1) & 63].tobytes().decode()


_known_paragraph = functools.lru_cache(1024)(_paragraph)


def fingerprint(text: str | None) -> str:
    """``root/leaves``: the root digest, then three characters for every piece, without a mark between them,
    paragraphs separated by ``|`` and sections by ``;``: about half as long as a text of words.

    Paragraphs are lines. A section ends at a blank line or at a paragraph whose digest says so.
    Pieces are hashed to 128 bits, paragraphs hash their pieces, sections their paragraphs, the root its
    sections; so roots are equal for equal texts only, but for collisions of 128 bits. Null reads as ''.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    sections, own, own_hex, shown = [], [], [], []
    for line in raw.split(b"\n"):
        node, marks = (_known_paragraph if len(line) < KEPT else _paragraph)(line)
        own.append(node)
        own_hex.append(marks)
        if not line.strip() or node[0] % 4 == 0:
            sections.append(_hash(b"s" + b"".join(own)))
            shown.append("|".join(own_hex))
            own, own_hex = [], []
    if own:
        sections.append(_hash(b"s" + b"".join(own)))
        shown.append("|".join(own_hex))
    return _hash(b"r" + b"".join(sections)).hex() + "/" + ";".join(shown)


def _tree(mark: str) -> list[list[str]]:
    return [section.split("|") for section in mark.partition("/")[2].split(";")]


def _leaves(paragraph: str) -> np.ndarray:
    """The 18-bit numbers of a row of leaves; an end mark is greater than all."""
    return _VALUE[np.frombuffer(paragraph.encode(), np.uint8)].reshape(-1, LEAF) @ np.array([4096, 64, 1])


def _pairs(paragraphs: Counter) -> np.ndarray:
    """Neighbours in some paragraphs, as one number each, their ends counted as neighbours of an end mark."""
    row = _leaves(END + "".join(p + END for p in paragraphs.elements()))
    return (row[:-1] << 20) + row[1:]


def _n_common(left: np.ndarray, right: np.ndarray) -> int:
    """What both have, as often as both have it."""
    (x, n), (y, m) = (np.unique(side, return_counts=True) for side in (left, right))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def likeness(a: str, b: str) -> float:
    """Twice the common neighbourhoods of pieces over those of both, 1 for equal roots.

    A neighbourhood is a piece and the one behind it, or an end of the paragraph: the same words in another
    order share few. Equal branches are settled whole: sections first, then paragraphs, then single pieces.
    """
    if a.partition("/")[0] == b.partition("/")[0]:
        return 1.0
    left, right = (Counter(m.partition("/")[2].split(";")) for m in (a, b))
    # A paragraph of n pieces has n + 1 neighbourhoods.
    count = lambda node: len(node.replace("|", "")) // LEAF + node.count("|") + 1
    total = sum(count(x) * n for side in (left, right) for x, n in side.items())
    common = left & right
    same = sum(count(x) * n for x, n in common.items())
    left, right = (Counter(p for s, n in (side - common).items() for p in s.split("|") for _ in range(n))
                   for side in (left, right))
    common = left & right
    same += sum(count(x) * n for x, n in common.items())
    same += _n_common(_pairs(left - common), _pairs(right - common))
    return 2 * same / total


def differing(a: str, b: str) -> list[tuple[int, int, int]]:
    """Where ``b`` has what ``a`` has nowhere: (section, paragraph, piece) numbers in ``b``.

    Sections and paragraphs that ``a`` also has are passed over without looking inside.
    """
    if a.partition("/")[0] == b.partition("/")[0]:
        return []
    known = _tree(a)
    sections = {"|".join(s) for s in known}
    paragraphs = {p for s in known for p in s}
    pieces = {x for p in paragraphs for x in _leaves(p).tolist()}
    return [(i, j, k) for i, s in enumerate(_tree(b)) if "|".join(s) not in sections
            for j, p in enumerate(s) if p not in paragraphs
            for k, x in enumerate(_leaves(p).tolist()) if x not in pieces]


def edited(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by as many first characters of ``following``."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


RESULT = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _row(key, text: str, mark: str, following: str, next_mark: str) -> tuple:
    other = edited(text, following)
    other_mark = fingerprint(other)
    digest = hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest()
    return key, len(text), digest, mark, other_mark, likeness(mark, other_mark), likeness(mark, next_mark)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _schema(kind: pa.DataType) -> pa.Schema:
    s, d = pa.string(), pa.float64()
    return pa.schema([("_key", kind), ("n_chars", pa.int64()), ("edited_sha256", s), ("fingerprint", s),
                      ("edited_fingerprint", s), ("near_edited", d), ("near_next", d)])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition with their successors; all but the last one."""
    last = None
    for batch in batches:
        rows, size = [], 0
        for key, text in zip(batch.column(0), batch.column(1)):
            text = text.as_py() or ""
            now = (key.as_py(), text, fingerprint(text))
            if last is not None:
                rows.append(_row(*last, *now[1:]))
                size += len(rows[-1][3]) + len(rows[-1][4])
            last = now
            if size > 1 << 23:
                yield _batch(rows, _schema(batch.schema.field(0).type))
                rows, size = [], 0
        if rows:
            yield _batch(rows, _schema(batch.schema.field(0).type))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last row of a sorted partition."""
    first = last = None
    for batch in batches:
        if batch.num_rows:
            first = first or batch.slice(0, 1)
            last = batch.slice(batch.num_rows - 1, 1)
    for which, row in ((0, first), (1, last)):
        if row is not None:
            yield pa.record_batch(
                [pa.array([2 * TaskContext.get().partitionId() + which], pa.int64()), *row.columns],
                names=["_place", *row.schema.names])


def _closing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, text, following in zip(*[batch.column(i) for i in range(3)]):
            a, b = text.as_py() or "", following.as_py() or ""
            yield _batch([_row(key.as_py(), a, fingerprint(a), b, fingerprint(b))],
                         _schema(batch.schema.field(0).type))


def fingerprint_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text",
                          rows_per_partition: int = 20_000) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row.

    The next document is the one with the next key (after the last: the first); its
    beginning makes the edited text. Texts are range-partitioned by key once and read in order, holding
    two documents at a time. The last row of a partition needs the first one of the next: a second reader
    of the same exchange passes on two rows per partition, however many rows there are.

    Null texts read as ''. Rows with equal keys come in the order of a text hash; a null key comes
    first. A single row is its own next. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    slim = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                -(-slim.select("_key").count() // rows_per_partition))
    order = ["_key", F.xxhash64("_text")]
    ordered = slim.repartitionByRange(parts, "_key").sortWithinPartitions(*order)
    kind = slim.schema["_key"].dataType.simpleString()
    inner = ordered.mapInArrow(_in_order, f"_key {kind}, {RESULT}")
    ends = ordered.mapInArrow(_ends, f"_place long, _key {kind}, _text string")
    by_place = W.orderBy("_place")
    whole = by_place.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    closing = ends.select(
        "_place", "_key", "_text",
        F.coalesce(F.lead(F.coalesce("_text", F.lit(""))).over(by_place),
                   F.first(F.coalesce("_text", F.lit(""))).over(whole)).alias("_next")).where("_place % 2 = 1")
    outer = closing.select("_key", "_text", "_next").mapInArrow(_closing, f"_key {kind}, {RESULT}")
    return inner.union(outer).withColumnRenamed("_key", key)

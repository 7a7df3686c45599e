"""Best-fit packing of tokenised documents, bulk-synchronously.

Documents (pieces of up to `capacity` tokens) and the gaps of open sequences are rows that are range-sorted together by size,
largest first, a gap before a document of its size. In one round

1. every range is swept: a document takes its successor, the smallest gap that holds it of those seen so far; documents that
   want the same gap are told apart by their rank; what is left of a gap comes up again where its size is due. In the first
   range, above which there are no gaps, a document without a gap opens a sequence;
2. what a range leaves over, documents that found no gap and gaps that can hold any document of the ranges below, is carried
   across the ranges: their counts (a row a range) say which ranks of documents meet which ranks of gaps, and a join brings
   these together;
3. the gaps shrink, those smaller than every open document are closed, and the round is repeated with the documents left;
4. while there are several ranges, documents larger than every gap need new sequences in all of them: one each for those of
   over half a sequence, and for the others half as many as their tokens fill, so that the next rounds can pair what is left.
   Never more sequences are opened than the documents without a gap need.

Full pieces are sequences of their own. A row is a size and two numbers, so rounds shuffle a small part of the input;
the driver sees counts by range and by size. The number of sequences is that of best-fit decreasing or some hundredths of a
percent above.

Token ids are those of the tokenizer of the vocabulary file. Where that is a plain byte-level one whose merges are in the order of its
ids, texts of characters that every Unicode version classes alike are encoded by a rank encoder over the same vocabulary, at a
fraction of the cost; one in CHECKED of them goes through the tokenizer as well, and a difference is an error. All others (rare
characters, special tokens, very long runs of white space, other tokenizers) go through the tokenizer itself. Nothing is kept between texts.

Cases: a null or empty text is one piece that holds the end token alone; a very long text is cut into pieces, one shorter than
the capacity; equal rows are packed one by one; ties are broken by rank; an empty table gives an empty result; only the id and the
text are read.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import bounded_batches, written

CAPACITY = 1024
END_TOKEN = 2
#: Rows of a range while there are few ranges, and from some two thousand ranges on.
RANGE_ROWS, RANGE_ROWS_MOST = 100_000, 2_000_000
#: Of so many texts that the rank encoder takes one is encoded by the tokenizer too.
CHECKED = 64
#: So many sequences are opened at once whatever half the need is: the last few need no rounds of their own.
OPEN_LEAST = 64
#: How byte-level vocabularies spell bytes, printable ones as themselves, others from U+0100 on; and how they part texts.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that may be classed otherwise by another Unicode version: all but Latin, Greek, Cyrillic, Hebrew and Arabic letters,
#: kana, Han and Hangul, and common punctuation. BLANK: white space too long for an engine that looks ahead.
RARE = re.compile(
    r"[^\x00-\u024f\u0391-\u03a1\u03a3-\u03c9\u0400-\u0481\u048a-\u04ff\u05d0-\u05ea\u0621-\u064a\u2010-\u2027\u2030-\u205e\u20ac\u3001-\u3003\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]"
)
BLANK, BLANK_LEAST = re.compile(r"\s{50000}"), 50_000


def rank_encoder(vocabulary_path: str):
    """An encoder over the same vocabulary, for byte-level tokenizers that merge in the order of their ids; None for others."""
    import tiktoken

    with open(vocabulary_path, encoding="utf-8") as f:
        said = json.load(f)
    model, parting = said["model"], said.get("pre_tokenizer") or {}
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if model.get("type") != "BPE" or said.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or {k: parting.get(k) for k in plain} != plain:
        return None
    merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in merged or any(a >= b for a, b in itertools.pairwise(merged)):
        return None
    special = {t["content"] for t in said.get("added_tokens", [])}
    octet = {chr(b): b for b in _PRINTED} | {c: b for b, c in ALPHABET.items()}
    ranks = {bytes(octet[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    return tiktoken.Encoding("ranks", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def encoder(vocabulary_path: str) -> Callable[[str], np.ndarray]:
    """text -> uint32 ids of the tokenizer in vocabulary_path."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task
    from tokenizers import Tokenizer

    whole, ranks = Tokenizer.from_file(vocabulary_path), rank_encoder(vocabulary_path)
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    count = itertools.count()

    def exact(text: str) -> np.ndarray:
        return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(text: str) -> np.ndarray:
        odd = not text.isascii() and RARE.search(text) or len(text) > BLANK_LEAST and BLANK.search(text)
        if ranks is None or odd or any(s in text for s in special):
            return exact(text)
        found = np.array(ranks.encode_ordinary(text), np.uint32)
        if next(count) % CHECKED == 0 and not np.array_equal(found, exact(text)):
            raise ValueError(f"the vocabulary's ranks and its tokenizer differ on {text[:200]!r}")
        return found

    return ids


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, but the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, end: int, vocabulary_path: str) -> DataFrame:
    """A row a piece, with a number of its own."""
    picked = docs.select(id_col, text_col)
    schema = f"`{id_col}` {picked.dtypes[0][1]}, piece int, start bigint, length bigint, ids_crc32 bigint, row_ bigint"
    names = [id_col, "piece", "start", "length", "ids_crc32", "row_"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(vocabulary_path)
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                tokens = np.append(ids(text.as_py() or ""), np.uint32(end)).astype("<u4")
                for k, (s, n) in enumerate(cut(len(tokens), capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(tokens[s : s + n].tobytes()))
            long = [pa.array(x, pa.int64()) for x in (start, length, crc, range(number, number + len(row)))]
            number += len(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *long], names=names)

    return picked.mapInArrow(run, schema)


GAP, OPEN, PLACED = 0, 1, 2
#: Numbers of sequences: of full pieces below 0, of those opened in all ranges from 0 on, of those that a document opened from here on.
OPENED = 1 << 62
#: what a row is, its size (tokens or gap), its number (row or sequence); of placed rows sequence and offset; the range and the
#: rank among the range's rows left over, gaps from the smallest on, documents from the largest on.
STATE = "what int, size bigint, id bigint, sequence bigint, offset bigint, span int, rank bigint"


def sweep(size: np.ndarray, doc: np.ndarray, capacity: int, opens: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One range, largest first, gaps before documents of their size: for each document the row of the gap it takes (of the
    document that opened its sequence; -1: none) and its offset, and for each gap, and each document that opened a sequence, the
    size that is left."""
    n = len(size)
    gap_of, offset = np.full(n, -1), np.zeros(n, np.int64)
    left = np.where(doc, 0, size)
    edges = np.flatnonzero(np.concatenate([np.ones(min(1, n), bool), (size[1:] != size[:-1]) | (doc[1:] != doc[:-1])]))
    due: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by size: runs of rows of equal gaps
    docs: dict[int, tuple[int, int]] = {}
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), n]):
        if doc[a]:
            docs[int(size[a])] = (a, b)
        else:
            due[int(size[a])].append((a, b))
    free: list[tuple[int, int, int]] = []  # gaps seen, the smallest last: first row, last row, size
    for length in range(capacity, 0, -1):
        free += [(x, y, length) for x, y in due[length]]
        a, b = docs.get(length, (0, 0))
        while a < b and (free or opens):
            if free:
                first, last, room = free.pop()
            else:  # the documents that come first open a sequence each
                first, last, room = a, a + -(-(b - a) // (capacity // length)), capacity
                took = last - first
                gap_of[first:last] = np.arange(first, last)
                a, room, last = last, capacity - length, last
                each = capacity // length - 1
                if not each:
                    left[first:last] = room
                    due[room].append((first, last))
                    continue
            each = room // length
            used = min(last - first, -(-(b - a) // each))  # the last of them may take fewer
            took = min(b - a, used * each)
            nth = np.arange(took)
            gap_of[a : a + took] = first + nth // each
            offset[a : a + took] = capacity - room + nth % each * length
            a += took
            whole = took // each
            left[first : first + whole] = room - each * length
            due[room - each * length].append((first, first + whole))
            if first + used < last:
                left[first + used : last] = room
                free.append((first + used, last, room))
            if whole < used:
                left[first + whole] = rest = room - took % each * length
                free.append((first + whole, first + used, rest))
    return gap_of, offset, left


def swept(state: DataFrame, spans: int, capacity: int) -> DataFrame:
    """A round's step 1: documents and gaps, range-sorted and swept range by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        span = TaskContext.get().partitionId()
        what, size, number = (np.concatenate([b.column(k).to_numpy() for b in rows]) for k in range(3))
        doc = what == OPEN
        gap_of, offset, left = sweep(size, doc, capacity, span == 0)
        got = gap_of >= 0
        open_docs, gaps = np.flatnonzero(doc & ~got), np.flatnonzero(left > 0)
        spare = gaps[left[gaps] >= size[-1]]
        rank = np.full(len(size), -1)
        rank[spare[np.argsort(left[spare], kind="stable")]] = np.arange(len(spare))
        # A document that opened a sequence is two rows: itself, placed, and its gap, whose number is the document's.
        sequence = np.where(got & ~doc[gap_of], number[gap_of], number[gap_of] + OPENED)
        yield table_of(span, np.full(len(gaps), GAP), left[gaps], number[gaps] + np.where(doc[gaps], OPENED, 0), rank=rank[gaps])
        yield table_of(span, np.full(len(open_docs), OPEN), size[open_docs], number[open_docs], rank=np.arange(len(open_docs)))
        at = np.flatnonzero(got)
        yield table_of(span, np.full(len(at), PLACED), size[at], number[at], sequence[at], offset[at])

    order = [F.desc("size"), F.asc("what"), F.xxhash64("id"), F.asc("id")]
    state = state.select("what", "size", "id")
    ranges = state.coalesce(1) if spans == 1 else state.repartitionByRange(spans, *order)
    return ranges.sortWithinPartitions(*order).mapInArrow(run, STATE)


def table_of(span: int, what: np.ndarray, size: np.ndarray, number: np.ndarray, sequence=None, offset=None, rank=None) -> pa.RecordBatch:
    fill = lambda x: np.full(len(what), -1) if x is None else x
    columns = [what.astype(np.int32), size, number, fill(sequence), fill(offset), np.full(len(what), span, np.int32), fill(rank)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in STATE.split(", ")])


def met(left: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Which documents left over meet which gaps left over, by ranges from the largest sizes on: (documents' range, first
    rank, how many, gaps' range, first rank). left: range -> (documents, gaps); a range's gaps are smaller than its documents."""
    free: list[list[int]] = []  # range, first rank free, gaps free
    out = []
    for span in sorted(left):
        docs, gaps = left[span]
        rank = 0
        while rank < docs and free:
            top = free[-1]
            n = min(docs - rank, top[2])
            out.append((span, rank, n, top[0], top[1]))
            rank, top[1], top[2] = rank + n, top[1] + n, top[2] - n
            if not top[2]:
                free.pop()
        if gaps:
            free.append([span, 0, gaps])
    return out


def carried(rows: DataFrame, meets: list[tuple[int, int, int, int, int]], capacity: int) -> DataFrame:
    """A round's step 2: documents take gaps of other ranges, one each."""
    table = np.array(meets, np.int64)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    key = (table[:, 0] << 40) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            span, rank = (batch.column(k).to_numpy() for k in (2, 3))
            at = np.maximum(np.searchsorted(key, (span.astype(np.int64) << 40) + rank, "right") - 1, 0)
            beyond = rank - table[at, 1]
            hit = (table[at, 0] == span) & (beyond >= 0) & (beyond < table[at, 2])
            wants = [pa.array(v, mask=~hit) for v in (table[at, 3].astype(np.int32), table[at, 4] + beyond)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *wants], names=["doc", "length", "span", "rank"])

    docs = rows.where(f"what = {OPEN}").select(F.col("id").alias("doc"), F.col("size").alias("length"), "span", "rank")
    asking = docs.mapInArrow(run, "doc bigint, length bigint, span int, rank bigint")
    free = rows.where(f"what = {GAP} and rank >= 0")
    none, columns = F.lit(None).cast("bigint"), ["what", "size", "id", "sequence", "offset"]
    row = lambda what, size, number, seq, offset: F.struct(*[c.alias(n) for c, n in zip((F.lit(what), size, number, seq, offset), columns)])
    size, length = F.col("size"), F.col("length")
    pairs = free.join(asking.where("span is not null"), ["span", "rank"], "left")
    gap = row(GAP, size - F.coalesce(length, F.lit(0)), F.col("id"), none, none)
    taken = row(PLACED, length, F.col("doc"), F.col("id"), F.lit(capacity) - size)
    moved = pairs.select(F.explode(F.when(F.col("doc").isNull(), F.array(gap)).otherwise(F.array(gap, taken))).alias("r")).select("r.*").where("size > 0")
    waiting = asking.where("span is null").select(F.lit(OPEN).alias("what"), F.col("length").alias("size"), F.col("doc").alias("id"), none.alias("sequence"), none.alias("offset"))
    return rows.where(f"what = {PLACED} or (what = {GAP} and rank < 0)").select(*columns).unionByName(moved).unionByName(waiting)


def opened(gaps: dict[int, int], docs: dict[int, int], capacity: int) -> int:
    """How many sequences to open for the documents that are larger than every gap; gaps, docs: size -> how many."""
    largest = max(gaps, default=0)
    without = {n: k for n, k in docs.items() if n > largest}
    alone = sum(k for n, k in without.items() if 2 * n > capacity)
    need = -(-sum(n * k for n, k in without.items()) // capacity)
    return alone or max(-(-need // 2), min(OPEN_LEAST, need))


def packed_rows(state: DataFrame, capacity: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(row_, sequence_id, offset) of documents given as (what, size, id); rounds until none is left open."""
    spark = state.sparkSession
    done: list[DataFrame] = []
    count = lambda df: {(r[0], r[1]): r[2] for r in df.where(f"what <> {PLACED}").groupBy("what", "size").count().collect()}  # noqa: E731  at most 2 x capacity rows
    sizes, sequences = count(state), 0
    while docs := {n: k for (what, n), k in sizes.items() if what == OPEN}:
        gaps = {n: k for (what, n), k in sizes.items() if what == GAP and n >= min(docs)}
        rows = sum(docs.values()) + sum(gaps.values())
        spans = max(min(rows // range_rows, 2_000), rows // RANGE_ROWS_MOST) + 1
        if spans > 1 or done:
            new = opened(gaps, docs, capacity)
            fresh = spark.range(sequences, sequences + new).select(F.lit(GAP).alias("what"), F.lit(capacity).cast("bigint").alias("size"), "id")
            state, sequences = state.unionByName(fresh), sequences + new
        round_ = written(swept(state.where(F.col("size") >= min(docs)), spans, capacity), "swept")
        left = {r[0]: (r[1], r[2]) for r in round_.where("rank >= 0").groupBy("span").agg(F.count_if(F.col("what") == OPEN), F.count_if(F.col("what") == GAP)).collect()}
        if meets := met(left):
            round_ = written(carried(round_, meets, capacity), "carried")
        done.append(round_.where(f"what = {PLACED}").select(F.col("id").alias("row_"), F.col("sequence").alias("sequence_id"), "offset"))
        state = round_.where(f"what <> {PLACED}").select("what", "size", "id")
        sizes = count(round_)
    return reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], "row_ bigint, sequence_id bigint, offset bigint")


def best_fit(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END_TOKEN, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Pieces of all documents with their sequence and offset. Full pieces have sequences of negative numbers."""
    bounded_batches(docs.sparkSession)
    pieces = written(token_pieces(docs, id_col, text_col, capacity, end, vocabulary_path), "pieces")
    part = pieces.where(F.col("length") < capacity)
    placed = packed_rows(part.select(F.lit(OPEN).alias("what"), F.col("length").alias("size"), F.col("row_").alias("id")), capacity, range_rows)
    columns = [id_col, "piece", "start", "length", "ids_crc32"]
    full = pieces.where(F.col("length") == capacity).select(*columns, (-1 - F.col("row_")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return part.join(placed, "row_").select(*columns, "sequence_id", "offset").unionByName(full)

"""Repeated windows of a corpus, found exactly through minimiser-partitioned segments.

A window is W consecutive units (words or bytes) of one document; its minimiser is the smallest hash among its grams.
Consecutive windows that share a minimiser form a segment (a super-k-mer). Equal windows have equal minimisers, so:

1. the rows are numbered in a written table, in which about GROUP_BYTES of neighbouring texts are a group;
2. each group's minimisers and their places are counted where the table is read; those with one place in the corpus can't
   hold a repeat and are dropped;
3. the groups' texts are shuffled, once, to meet what they need; the other minimisers' segments travel, packed as one string each and equal ones of a group merged, to their minimiser's bucket;
4. a bucket compares the windows of its distinct segments, which shows the windows that start more than once;
5. the spans so found go back to the documents' groups.

A minimiser with more than HOT places would overfill a bucket, so its segments are cut into windows (segments whose
minimiser is the whole window) and step 2 is repeated for these: their digests are counted, and only windows whose digest
occurs more than once travel. They travel as packed strings, equal ones of a group merged, and are counted by Spark's own
aggregate over the strings. Windows are compared by their units on both ways; nothing is capped.

Minimisers, digests and hot windows all come as rows of (key, group), which are shuffled to their key's total. A key that very
many groups hold would gather a row of each in one task, so such keys are looked for in a share of the groups: their rows stay where
they are, are summed there before the sums travel, and the totals are sent to them.

Longer texts than PIECE units are hashed piece by piece, so a text costs a small multiple of itself.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import GROUP, LIST_BYTES, ROW, as_bytes, bounded_batches, dealt, gram_hash, octets, sliding_min, written

GROUP_BYTES = 4 << 20
#: Places of one minimiser that a bucket gathers: some 50 MB of packed strings, were all of them different.
HOT = 131_072
#: Keys that some MANY groups hold are looked for in a 1/SHARE of the groups; bytes of such a key, with its totals.
MANY, SHARE, KEY_BYTES = 4096, 64, 512
#: Units handled at once; longer documents are cut into pieces that overlap by a window less one unit.
PIECE = 1 << 20


@dataclass(frozen=True)
class Unit:
    """What windows are made of. `split`: a text's units; `hashes`: 64 bits a unit; `pack`: units as one string;
    `repeats`: for distinct packed strings, how often each occurs, and the row and start of its first place: (windows before
    each string, windows that occur anywhere else, windows that occur at an earlier place)."""

    window: int
    gram: int
    split: Callable
    hashes: Callable
    pack: Callable
    repeats: Callable


def pieces(unit: Unit, texts: list[bytes | None]):
    """Texts with a window in batches of about PIECE units: [(text's index, units before the piece, its units)], the hashes
    of all grams, the smallest of each window, and which windows lie inside one piece."""
    w = unit.window
    batch: list[tuple[int, int, int]] = []
    parts: list[np.ndarray] = []
    held = 0

    def ready():
        h = np.concatenate(parts)
        of = np.repeat(np.arange(len(batch)), [b[2] for b in batch])
        grams = gram_hash(h, unit.gram)
        return list(batch), grams, sliding_min(grams, w - unit.gram + 1), of[: len(h) - w + 1] == of[w - 1 :], of

    for row, text in enumerate(texts):
        units = unit.split(text or b"")
        if len(units) < w:
            continue
        for a in range(0, len(units) - w + 1, PIECE):
            part = unit.hashes(units[a : a + PIECE + w - 1])
            batch.append((row, a, len(part)))
            parts.append(part)
            held += len(part)
            if held >= PIECE:
                yield ready()
                batch, parts, held = [], [], 0
    if batch:
        yield ready()


def segments(unit: Unit, texts: list[bytes | None]):
    """(text's index, segment starts, windows in each, minimisers), piece by piece."""
    for batch, _, least, valid, of in pieces(unit, texts):
        n = len(least)
        cut = np.ones(n, bool)
        cut[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1]) | (of[1:n] != of[: n - 1])
        at = np.flatnonzero(cut)
        size = np.diff(np.append(at, n))
        good = valid[at]
        at, size = at[good], size[good]
        first = np.cumsum([0, *(b[2] for b in batch)])
        edges = np.searchsorted(at, first)
        for k, (row, shift, _) in enumerate(batch):
            a, b = edges[k], edges[k + 1]
            if a < b:
                yield row, at[a:b] - first[k] + shift, size[a:b], least[at[a:b]]


def minimisers(unit: Unit, grouped: DataFrame, text_col: str) -> DataFrame:
    """Per group and minimiser the number of its places. Two equal windows hold their minimiser at two places, in whatever
    documents or segments they lie, so a minimiser with one place in the corpus has no repeat. A group that two batches
    hold gives two rows."""

    def count(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.empty(0, np.uint64)]
        for _, grams, least, valid, _ in pieces(unit, texts):
            pad = np.zeros(unit.window - unit.gram, np.uint64)
            low = np.concatenate([pad, np.where(valid, least, np.uint64(0)), pad])
            # Of the windows that hold a gram, the largest minimum equals the gram if it is a minimum itself.
            found.append(grams[~sliding_min(~low, unit.window - unit.gram + 1) == grams])
        return np.unique(np.concatenate(found), return_counts=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, texts = batch.column(0).to_numpy(), as_bytes(batch.column(1))
            edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1)).tolist()
            for a, b in zip(edges, edges[1:]):
                values, counts = count(texts[a:b])
                columns = [pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64)), pa.array(np.full(len(values), group[a]))]
                yield pa.RecordBatch.from_arrays(columns, names=["least", "n", GROUP])

    return grouped.select(GROUP, text_col).mapInArrow(run, f"least bigint, n bigint, {GROUP} bigint")


def needed_segments(unit: Unit, texts: list[bytes | None], keys: np.ndarray, hot: np.ndarray):
    """(text's index, its units, start, windows, minimiser, hot) of each segment whose minimiser is among the keys."""
    order = np.argsort(keys)
    keys, hot = keys[order], hot[order]
    for row, start, size, least in segments(unit, texts) if len(keys) else ():
        at = np.minimum(np.searchsorted(keys, least), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == least)
        if len(hit):
            units = unit.split(texts[row])
            for s, n, m, heavy in zip(start[hit].tolist(), size[hit].tolist(), least[hit].view(np.int64).tolist(), hot[at[hit]].tolist()):
                yield row, units, s, n, m, heavy


def asked(wants: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = wants.column("least").to_numpy().view(np.uint64)
    return keys, wants.column("hot").to_numpy(zero_copy_only=False).astype(bool)


def window_digests(unit: Unit, grouped: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """Per group and window of a hot minimiser the number of its places, the window as a digest."""

    def run(rows: pa.Table, wants: pa.Table) -> pa.Table:
        found: Counter[bytes] = Counter()
        if wants.num_rows and rows.num_rows:
            texts = as_bytes(rows.column(text_col))
            for _, units, s, n, _, _ in needed_segments(unit, texts, *asked(wants)):
                found.update(xxhash.xxh3_128_digest(unit.pack(units[a : a + unit.window])) for a in range(s, s + n))
        home = rows.column(GROUP)[0].as_py() if rows.num_rows else 0
        return pa.table({"digest": pa.array(list(found), pa.binary()), "n": pa.array(list(found.values()), pa.int64()), "home": pa.array(np.full(len(found), home))})

    schema = "digest binary, n bigint, home bigint"
    return grouped.groupBy(GROUP).cogroup(wanted.groupBy("wanted_by")).applyInArrow(run, schema)


def with_totals(rows: DataFrame, key: str, home: str, totals: list[Column], keep: str, share: int = SHARE, many: int = MANY) -> DataFrame:
    """The rows whose key's totals pass `keep`, with the totals. They are shuffled once, for the sums and for the join; those of keys that
    about `many` groups or more hold, by a 1/share of the groups, are not shuffled at all."""

    def shuffled(part: DataFrame) -> DataFrame:
        dealt_out = part.repartition(key)  # both readers of the shuffle ask the same of it, or it would be made twice
        return dealt_out.join(dealt_out.groupBy(key).agg(*totals).where(keep), key)

    counted = rows.where(F.pmod(F.xxhash64(home), F.lit(share)) == 0).groupBy(key).agg(F.count("*").alias("held_"))
    hot = written(counted.where(F.col("held_") >= max(2, many // share)).select(key), "hot-keys")
    n = hot.count()
    if not n:
        return shuffled(rows)
    sent = F.broadcast if n * KEY_BYTES <= LIST_BYTES else lambda df: df
    mine = rows.join(sent(hot), key)
    sums = mine.groupBy(key).agg(*totals).where(keep)
    return shuffled(rows.join(sent(hot), key, "left_anti")).unionByName(mine.join(sent(sums), key))


def repeated(counted: DataFrame, key: str, home: str, **hot_keys: int) -> DataFrame:
    """The rows of keys with more than one place, and `total`."""
    rows = counted.where(F.col(key).isNotNull() & F.col(home).isNotNull())
    totals = [F.sum("n").alias("total"), F.min(home).alias("some_")]
    found = with_totals(rows, key, home, totals, "total > 1 and some_ is not null", **hot_keys)
    return found.where((F.col(home) >= F.col("some_")) & (F.col("n") > 0)).select(key, home, "total")


def shipped(unit: Unit, grouped: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """The packed segments of wanted minimisers, and the packed windows of wanted digests, of hot ones: equal ones of a group as
    one row with their places."""

    def run(rows: pa.Table, wants: pa.Table) -> pa.Table:
        numbers = rows.column(ROW).to_numpy()
        again = set(wants.column("digest").drop_null().to_pylist())
        places: dict[tuple[int, bool, bytes], list[tuple[int, int]]] = defaultdict(list)
        mins = wants.filter(pc.is_valid(wants.column("least")))
        texts = as_bytes(rows.column(text_col)) if mins.num_rows else []
        for row, units, s, n, m, heavy in needed_segments(unit, texts, *asked(mins)):
            number = int(numbers[row])
            if not heavy:
                places[m, False, unit.pack(units[s : s + n + unit.window - 1])].append((number, s))
                continue
            for a in range(s, s + n) if again else ():
                packed = unit.pack(units[a : a + unit.window])
                if xxhash.xxh3_128_digest(packed) in again:
                    places[xxhash.xxh3_64_intdigest(packed) - (1 << 63), True, packed].append((number, a))
        spots = list(places.values())
        ends = pa.array(np.cumsum([0, *map(len, spots)]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array([p[k] for s in spots for p in s], pa.int64())) for k in (0, 1)]
        home = rows.column(GROUP)[0].as_py() if rows.num_rows else 0
        return pa.table(
            {
                "key": pa.array([k[0] for k in places], pa.int64()),
                "hot": pa.array([k[1] for k in places], pa.bool_()),
                "packed": pa.array([k[2] for k in places], pa.binary()),
                "rows": lists[0],
                "starts": lists[1],
                "home": pa.array(np.full(len(places), home)),
            }
        )

    schema = "key bigint, hot boolean, packed binary, rows array<bigint>, starts array<bigint>, home bigint"
    return grouped.groupBy(GROUP).cogroup(wanted.groupBy("wanted_by")).applyInArrow(run, schema)


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (n[i] of them) for each i."""
    total = int(n.sum())
    return np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def runs(flags: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of set flags within equal `of`: their first index and the one after their last."""
    edge = np.ones(len(flags) + 1, bool)
    edge[1:-1] = (flags[1:] != flags[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(edge)
    a, b = at[:-1], at[1:]
    return a[flags[a]], b[flags[a]]


def repeats_of(unit: Unit, packed: list[bytes], pack_of: np.ndarray, row: np.ndarray, start: np.ndarray, keep_first: bool):
    """Spans (row, from, to) of the bucket's repeated windows. packed: distinct; pack_of, row, start: every occurrence."""
    by = np.lexsort((start, row, pack_of))
    pack_of, row, start = pack_of[by], row[by], start[by]
    weight = np.bincount(pack_of, minlength=len(packed))
    first = np.cumsum(weight) - weight  # each string's earliest occurrence
    before, anywhere, earlier = unit.repeats(packed, weight, row[first], start[first])
    pack = np.repeat(np.arange(len(packed)), np.diff(before))
    offset = np.arange(len(pack)) - before[pack]
    earliest = np.zeros(len(pack_of), bool)
    earliest[first] = True
    out = []
    for flags, take in ((anywhere, ~earliest if keep_first else np.ones(len(pack_of), bool)), (earlier, earliest & keep_first)):
        occ = np.flatnonzero(take)
        a, b = runs(flags, pack)
        many = np.bincount(pack[a], minlength=len(packed))
        lead = np.cumsum(many) - many
        which = spread(lead[pack_of[occ]], many[pack_of[occ]])
        rep = np.repeat(occ, many[pack_of[occ]])
        out.append((row[rep], start[rep] + offset[a[which]], start[rep] + offset[b[which] - 1] + unit.window))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def bucket_spans(unit: Unit, sent: DataFrame, keep_first: bool) -> DataFrame:
    """Spans of repeated windows, packed as (row, from, to) numbers for each group of documents."""

    def run(rows: pa.Table) -> pa.Table:
        index: dict[bytes, int] = {}
        ids = np.array([index.setdefault(k, len(index)) for k in rows.column("packed").to_pylist()], np.int64)
        lists = rows.column("rows").combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        row, start = (rows.column(c).combine_chunks().flatten().to_numpy() for c in ("rows", "starts"))
        found = repeats_of(unit, list(index), np.repeat(ids, lengths), row, start, keep_first)
        known, at = np.unique(row, return_index=True)
        homes = np.repeat(rows.column("home").to_numpy(), lengths)[at]
        row, low, high = united(*found)
        home = homes[np.searchsorted(known, row)]
        order = np.argsort(home, kind="stable")
        home, places = home[order], np.stack([row[order], low[order], high[order]], 1)
        at = np.flatnonzero(np.concatenate([np.ones(min(1, len(home)), bool), home[1:] != home[:-1]]))
        ends = np.append(at, len(home)).tolist()
        return pa.table({"home": pa.array(home[at]), "spans": pa.array([places[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, "home bigint, spans binary")


def hot_spans(unit: Unit, windows: DataFrame, keep_first: bool, **hot_keys: int) -> DataFrame:
    """The same for windows of hot minimisers, which the groups hold one by one: counts go to the places, not places to a task."""
    place = F.array_min(F.transform(F.arrays_zip("rows", "starts"), lambda p: F.struct(p["rows"].alias("r"), p["starts"].alias("s"))))
    held = written(windows.where("packed is not null and home is not null"), "hot-windows")
    totals = [F.sum(F.size("rows")).alias("n"), F.min(place).alias("first"), F.min("home").alias("some_")]
    found = with_totals(held, "packed", "home", totals, "n > 1 and some_ is not null", **hot_keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for rows, starts, r, s in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4))):
                row, start = np.array(rows, np.int64), np.array(starts, np.int64)
                later = ~((row == r) & (start == s)) if keep_first else np.ones(len(row), bool)
                spans.append(np.stack([row, start, start + unit.window], 1)[later].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.binary())], names=["home", "spans"])

    picked = found.where("home >= some_").select("home", "rows", "starts", "first.r", "first.s")
    return picked.mapInArrow(run, "home bigint, spans binary")


def united(row: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and adjoining spans of a row as one."""
    if not len(row):
        return row, low, high
    order = np.lexsort((low, row))
    row, low, high = row[order], low[order], high[order]
    _, number = np.unique(row, return_inverse=True)
    lift = number * (int(high.max()) + 2)  # rows apart on one axis
    top = np.maximum.accumulate(high + lift)
    head = np.ones(len(row), bool)
    head[1:] = (low + lift)[1:] > top[:-1]
    at = np.flatnonzero(head)
    return row[at], low[at], (top - lift)[np.append(at[1:], len(row)) - 1]


def with_repeats(
    docs: DataFrame, unit: Unit, finish: Callable, schema, text_col: str = "text", keep_first: bool = False, group_bytes: int = GROUP_BYTES, hot: int = HOT
) -> DataFrame:
    """finish(table of a group's rows, list of (n, 2) span arrays by row) -> table of `schema`."""
    bounded_batches(docs.sparkSession)
    grouped = dealt(docs, text_col, group_bytes)
    buckets = -(-octets(grouped, text_col) // group_bytes) or 1
    counted = written(minimisers(unit, grouped, text_col), "minimisers").withColumnRenamed(GROUP, "wanted_by")
    wanted = written(repeated(counted, "least", "wanted_by").select("least", "wanted_by", (F.col("total") > hot).alias("hot")), "wanted-minimisers")
    heavy = wanted.where("hot")
    wants = wanted.withColumn("digest", F.lit(None).cast("binary"))
    sent = shipped(unit, grouped, wants.where("not hot"), text_col)
    spans = bucket_spans(unit, sent.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")), keep_first)
    if not heavy.isEmpty():
        again = repeated(written(window_digests(unit, grouped, heavy, text_col), "hot-digests"), "digest", "home")
        wants = wants.where("hot").unionByName(again.select(F.lit(None).cast("bigint").alias("least"), F.col("home").alias("wanted_by"), F.lit(True).alias("hot"), "digest"))
        spans = spans.unionByName(hot_spans(unit, shipped(unit, grouped, wants, text_col).select("packed", "rows", "starts", "home"), keep_first))

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        places = np.frombuffer(b"".join(found.column("spans").to_pylist()), np.int64).reshape(-1, 3)
        places = places[np.argsort(places[:, 0], kind="stable")]
        row, pairs = places[:, 0], places[:, 1:]
        numbers = rows.column(ROW).to_numpy()
        a, b = np.searchsorted(row, numbers), np.searchsorted(row, numbers, "right")
        return finish(rows.drop_columns([ROW, GROUP]), [pairs[i:j] for i, j in zip(a.tolist(), b.tolist())])

    return grouped.groupBy(GROUP).cogroup(spans.groupBy("home")).applyInArrow(run, schema)


def mask(n: int, spans: np.ndarray) -> np.ndarray:
    """Which of n units lie in a span."""
    if not len(spans):
        return np.zeros(n, bool)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, spans[:, 0], 1)
    np.add.at(edge, spans[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0

"""N-gram Jaccard join with several global token orders.

Documents are sets of word shingles; two link when the sets' Jaccard similarity is at least PERCENT hundredths. Under any
global order of tokens, linked sets share a token among each one's first |x| - ceil(t|x|) + 1 tokens (its prefix). Pairs must share
such tokens under each of several orders before they are verified exactly:

1. equal texts become one class; only classes are joined;
2. order 0 puts a fixed slice of all tokens first, those of frequency 1 before the rest. Only the slice's frequencies are
   counted, and a document whose whole prefix there has frequency 1 can't link with anything and leaves;
3. for the documents left the frequencies of all tokens are counted. The rarest-first order gives prefixes whose tokens are
   joined; tokens of frequency 1 make no pair but keep their places. HASHED more orders, by hashes that have nothing to do with
   frequency, give prefixes that a pair from the join must share as well, each of them;
4. stars: for each token the best-placed holder of each component is paired with the best-placed of all, as many pairs as
   holders at most. Links join components (at first each document is one), and stars are made between the new components
   until none joins;
5. what is left are pairs across components that no star showed. They are joined by token, length and position, without a
   token's largest component being paired with itself; holders of a frequent token are dealt into blocks, so that
   no task has all of them.

Steps 4 and 5 lose no component: a link inside a component changes nothing, every other link is found in step 5. Tokens are
64-bit hashes of shingles (two of one pair's shingles collide with a chance of about 1e-13).

Cases: null texts and texts without words have no shingles and link with nothing, not even with each other; texts of fewer
words than a shingle are one shingle; a very long text is one set, its prefix a tenth of it; ties in an order are broken by the
token's hash, ties between holders by row number; repeated rows are equal texts; null ids never name a component unless it has no
other; an empty table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import GROUP, LOWER, ODD, ROW, WordHash, as_bytes, bounded_batches, dealt, gram_hash, mix, octets, without_rows, written
from loomline.operators.components import connected_components

SHINGLE = 3
PERCENT = 90
#: Orders by hash beside the two by frequency.
HASHED = 2
#: Holders of a token in a block of step 5.
BLOCK = 512
#: Order 0 counts the tokens whose hash ends in one of these quarters.
SLICE = 4
GROUP_BYTES = 4 << 20
SET_BYTES = 8 << 20


def shingles(words: list[bytes], hashed: WordHash, k: int) -> np.ndarray:
    """The sorted distinct tokens of a text."""
    if not words:
        return np.empty(0, np.uint64)
    h = hashed(words)
    return np.unique(gram_hash(h, min(k, len(h))) ^ np.uint64(min(k, len(h)) * 0x1234567))


def prefix_length(n, percent: int):
    return n - -(-percent * n // 100) + 1


def packed_counts(tokens: np.ndarray, group: int, buckets: int) -> pa.Table:
    """A group's distinct tokens and how many of its documents hold each, packed by bucket of the token."""
    values, counts = np.unique(tokens, return_counts=True)
    bucket = ((values >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    values, counts, bucket = values[order], counts[order].astype(np.int32), bucket[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(bucket)), bool), bucket[1:] != bucket[:-1]]))
    ends = np.append(at, len(bucket))
    parts = [slice(a, b) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return pa.table(
        {
            "bucket": pa.array(bucket[at], pa.int32()),
            "by": pa.array([group] * len(at), pa.int64()),
            "tokens": pa.array([values[p].tobytes() for p in parts], pa.binary()),
            "counts": pa.array([counts[p].tobytes() for p in parts], pa.binary()),
        }
    )


PACKED = "bucket int, by bigint, tokens binary, counts binary"


def shared_tokens(packed: DataFrame) -> DataFrame:
    """For each group those of its tokens that two or more documents hold, with their frequency in all groups."""

    def run(rows: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in rows.column("tokens").to_pylist()]
        values = np.concatenate(parts)
        counts = np.concatenate([np.frombuffer(x, np.int32) for x in rows.column("counts").to_pylist()])
        order = np.argsort(values, kind="stable")
        ordered = values[order]
        head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        total = np.add.reduceat(counts[order], head)
        frequency = np.empty(len(values), np.int32)
        frequency[order] = np.repeat(total, np.diff(np.append(head, len(values))))
        by, tokens, out = rows.column("by").to_pylist(), [], []
        first = 0
        for p in parts:
            f = frequency[first : first + len(p)]
            tokens.append(p[f > 1].tobytes())
            out.append(f[f > 1].tobytes())
            first += len(p)
        return pa.table({"home": pa.array(by, pa.int64()), "tokens": pa.array(tokens, pa.binary()), "counts": pa.array(out, pa.binary())})

    return packed.groupBy("bucket").applyInArrow(run, "home bigint, tokens binary, counts binary").where(F.octet_length("tokens") > 0)


def known(shared: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A group's shared tokens, sorted, and their frequencies."""
    tokens = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in shared.column("tokens").to_pylist())])
    counts = np.concatenate([np.empty(0, np.int32), *(np.frombuffer(x, np.int32) for x in shared.column("counts").to_pylist())])
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def frequency_of(tokens: np.ndarray, shared: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    keys, counts = shared
    if not len(keys):
        return np.ones(len(tokens), np.int64)
    at = np.minimum(np.searchsorted(keys, tokens), len(keys) - 1)
    return np.where(keys[at] == tokens, counts[at], 1).astype(np.int64)


def token_sets(texts: list[bytes | None], k: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    hashed = WordHash()
    for text in texts:
        words = (text or b"").translate(LOWER).split()
        yield words, shingles(words, hashed, k)


def survivors(grouped: DataFrame, id_col: str, text_col: str, groups: int, k: int, percent: int) -> DataFrame:
    """Per row: row number, id, digest of its words, number of shingles and, where order 0 leaves the document, its tokens.

    The slice's tokens are counted where the table is read; the texts are shuffled once, to meet the counts."""
    rows = grouped.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(ROW).alias("row"), F.col(GROUP).alias("grp"))

    def in_slice(tokens: np.ndarray) -> np.ndarray:
        return tokens[tokens % np.uint64(SLICE) == 0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, texts = batch.column(0).to_numpy(), as_bytes(batch.column(1))
            edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1)).tolist()
            for a, b in zip(edges, edges[1:]):
                tokens = np.concatenate([np.empty(0, np.uint64), *(in_slice(s) for _, s in token_sets(texts[a:b], k))])
                yield from packed_counts(tokens, int(group[a]), groups).to_batches()

    def keep(rows: pa.Table, shared: pa.Table) -> pa.Table:
        table, digests, sizes, tokens = known(shared), [], [], []
        for words, s in token_sets(as_bytes(rows.column("text")), k):
            digests.append(hashlib.blake2b(b" ".join(words), digest_size=20).digest() if words else None)
            sizes.append(len(s))
            live = len(s) and (frequency_of(in_slice(s), table) == 1).sum() < prefix_length(len(s), percent)
            tokens.append(s.tobytes() if live else None)
        columns = {"row": rows.column("row"), "id": rows.column("id"), "digest": pa.array(digests, pa.binary()), "n": pa.array(sizes, pa.int64())}
        return pa.table(columns | {"tokens": pa.array(tokens, pa.binary())})

    shared = shared_tokens(rows.select("grp", "text").mapInArrow(count, PACKED))
    schema = f"row bigint, id {dict(rows.dtypes)['id']}, digest binary, n bigint, tokens binary"
    return rows.groupBy("grp").cogroup(shared.groupBy("home")).applyInArrow(keep, schema)


def first_by_hash(tokens: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The sorted prefix tokens of a set under the order by hash of this number."""
    n = prefix_length(len(tokens), percent)
    by = mix(tokens ^ np.uint64(order + 1)) * ODD
    return np.sort(tokens[np.argpartition(by, n - 1)[:n]])


def prefixes(sets: DataFrame, groups: int, percent: int) -> DataFrame:
    """Prefix tokens, rarest first, that other documents share: (token, row, n, place)."""
    grouped = sets.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("bigint"))

    def flat(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        parts = [np.frombuffer(x, np.uint64) for x in rows.column("tokens").to_pylist()]
        return np.concatenate([np.empty(0, np.uint64), *parts]), np.cumsum([0, *map(len, parts)])

    def count(rows: pa.Table) -> pa.Table:
        return packed_counts(flat(rows)[0], rows.column("grp")[0].as_py(), groups)

    def place(rows: pa.Table, shared: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if rows.num_rows:
            tokens, ends = flat(rows)
            frequency = frequency_of(tokens, known(shared))
            for row, a, b in zip(rows.column("row").to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                t, f = tokens[a:b], frequency[a:b]
                first = np.lexsort((mix(t), f))[: prefix_length(len(t), percent)]
                live = np.flatnonzero(f[first] > 1)
                for column, values in zip(out, (t[first[live]].view(np.int64), row, len(t), live)):
                    column.append(np.broadcast_to(values, len(live)))
        return pa.table({n: pa.array(np.concatenate(c) if c else [], pa.int64()) for n, c in zip(("token", "row", "n", "place"), out)})

    slim = grouped.select("grp", "row", "tokens")
    shared = shared_tokens(slim.groupBy("grp").applyInArrow(count, PACKED))
    return slim.groupBy("grp").cogroup(shared.groupBy("home")).applyInArrow(place, "token bigint, row bigint, n bigint, place bigint")


def with_hashed_prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """The sets with their prefixes under the orders by hash, as one string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = [b"".join(first_by_hash(np.frombuffer(t, np.uint64), o, percent).tobytes() for o in range(HASHED)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.binary())], names=["row", "tokens", "firsts"])

    return sets.mapInArrow(run, "row bigint, tokens binary, firsts binary")


def needed(x: str, y: str, percent: int) -> str:
    """SQL: the least overlap of two linked sets of these sizes."""
    return f"ceil({percent} * ({x} + {y}) / {100 + percent}.0D - 1e-9)"


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    both = np.sort(np.concatenate([x, y]))
    return int((both[1:] == both[:-1]).sum())


def pairs_with(pairs: DataFrame, sets: DataFrame, column: str, keep: Callable[[np.ndarray, np.ndarray], bool]) -> DataFrame:
    """The pairs (a, b) whose sets' columns, as numbers, pass."""
    left, right = (sets.select(F.col("row").alias(k), F.col(column).alias(f"{k}_")) for k in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [keep(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "a_", "b_").mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: those that share a prefix token under every order by hash are compared whole."""

    def share_firsts(x: np.ndarray, y: np.ndarray) -> bool:
        m, n = len(x) // HASHED, len(y) // HASHED
        return all(overlap(x[k * m : (k + 1) * m], y[k * n : (k + 1) * n]) for k in range(HASHED))

    def link(x: np.ndarray, y: np.ndarray) -> bool:
        return overlap(x, y) * (100 + percent) >= (len(x) + len(y)) * percent

    return pairs_with(pairs_with(pairs, sets, "firsts", share_firsts), sets, "tokens", link)


def close(x: str, y: str, percent: int) -> str:
    """SQL: whether two places of one token pass the length and positional filters."""
    need = needed(f"{x}n", f"{y}n", percent)
    return f"least({x}n, {y}n) * 100 >= greatest({x}n, {y}n) * {percent} and {x}n - {x}place >= {need} and {y}n - {y}place >= {need}"


def stars(posts: DataFrame, percent: int) -> DataFrame:
    """Pairs of each token's best-placed holder with the best-placed holder of every other component; posts have `part`."""
    each = posts.groupBy("token", "part").agg(F.min(F.struct("place", "row", "n")).alias("x"))
    best = each.groupBy("token").agg(F.min(F.struct("x.place", "x.row", "x.n", "part")).alias("y"), F.count("*").alias("parts_")).where("parts_ > 1")
    met = each.join(best, "token").where("part <> y.part").where(close("x.", "y.", percent))
    return met.select(F.least("x.row", "y.row").alias("a"), F.greatest("x.row", "y.row").alias("b")).distinct()


def in_parts(posts: DataFrame, parts: DataFrame) -> DataFrame:
    named = posts.drop("part").join(parts.withColumnRenamed("node", "row"), "row", "left")
    return named.select("token", "row", "n", "place", F.coalesce("component", "row").alias("part"))


def contested(posts: DataFrame) -> DataFrame:
    """The posts of tokens that several components hold."""
    several = posts.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("token")
    return posts.join(several, "token", "left_semi")


def across(posts: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Pairs of holders in different components that pass the filters. Of a token's largest component no two holders meet; a
    token's holders are dealt into blocks, and blocks meet one by one."""
    held = posts.groupBy("token", "part").agg(F.count("*").alias("m"))
    held = held.groupBy("token").agg(F.sum("m").alias("all_"), F.max(F.struct("m", "part")).alias("top"))
    held = held.select("token", F.expr(f"(all_ - top.m) div {block} + 1").alias("lefts"), F.expr(f"all_ div {block} + 1").alias("rights"), F.col("top.part").alias("top"))
    seen = posts.join(held, "token").withColumn("hash_", F.xxhash64("row"))
    left = seen.where("part <> top").withColumn("i", F.expr("pmod(hash_, lefts)")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rights") - 1)))
    right = seen.withColumn("j", F.expr("pmod(hash_, rights)")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lefts") - 1)))
    x = left.select("token", "i", "j", *(F.col(c).alias(f"x_{c}") for c in ("row", "n", "place", "part")))
    y = right.select("token", "i", "j", *(F.col(c).alias(f"y_{c}") for c in ("row", "n", "place", "part")), (F.col("part") == F.col("top")).alias("y_top"))
    met = x.join(y, ["token", "i", "j"]).where(f"x_part <> y_part and (y_top or x_row < y_row) and {close('x_', 'y_', percent)}")
    return met.select(F.least("x_row", "y_row").alias("a"), F.greatest("x_row", "y_row").alias("b")).distinct()


def joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links, (node, component), written; parts lists the nodes of components so far."""
    named = links
    for side in "ab":
        named = named.join(parts.select(F.col("node").alias(side), F.col("component").alias(f"{side}_")), side, "left")
    bridges = named.select(F.coalesce("a_", "a").alias("a"), F.coalesce("b_", "b").alias("b")).distinct()
    over = connected_components(bridges).select(F.col("node").alias("component"), F.col("component").alias("over"))
    nodes = parts.unionByName(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(parts, "node", "left_anti").select("node", F.col("node").alias("component")))
    return written(nodes.join(over, "component", "left").select("node", F.coalesce("over", "component").alias("component")), "parts")


def set_components(posts: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(node, component) of every set that links with another."""
    live = posts.withColumn("part", F.col("row"))
    parts = None
    while True:
        links = written(verified(stars(live, percent), sets, percent), "links")
        found = not links.isEmpty()
        if parts is None:
            parts = written(connected_components(links), "parts")
        elif found:
            parts = joined(parts, links)
        live = written(contested(in_parts(live, parts)), "contested")
        if not found or live.isEmpty():
            break
    if live.isEmpty():
        return parts
    rest = written(verified(across(live, percent, block), sets, percent), "links")
    return parts if rest.isEmpty() else joined(parts, rest)


def jaccard_components(
    numbered: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, percent: int = PERCENT, group_bytes: int = GROUP_BYTES, set_bytes: int = SET_BYTES, block: int = BLOCK
) -> DataFrame:
    """(row, id, n, digest, component, class) with one row per row of a dealt table; `component` is its smallest id."""
    groups = -(-octets(numbered, text_col) // group_bytes) or 1
    rows = written(survivors(numbered, id_col, text_col, groups, shingle, percent), "token-sets")
    heads = rows.where("n > 0").groupBy("digest").agg(F.min("row").alias("head"), F.min("id").alias("least"))
    live = rows.where("tokens is not null").select("row", "tokens")
    sets = written(with_hashed_prefixes(live.join(heads.select(F.col("head").alias("row")), "row", "left_semi").select("row", "tokens"), percent), "class-sets")
    posts = written(prefixes(sets, -(-octets(sets, "tokens") // set_bytes) or 1, percent), "postings")
    parts = set_components(posts, sets, percent, block)
    placed = heads.join(parts.select(F.col("node").alias("head"), "component"), "head", "left").withColumn("component", F.coalesce("component", "head"))
    names = placed.groupBy("component").agg(F.min("least").alias("name"))
    named_heads = placed.join(names, "component").select("digest", "name", "head", "component")
    return rows.drop("tokens").join(named_heads, "digest", "left").select(
        "row", "id", "n", "digest", F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("id")).alias("component"), F.coalesce("component", "row").alias("class")
    )


def component_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES, **options) -> DataFrame:
    """Per row: the size of its set and the smallest id of its component."""
    bounded_batches(docs.sparkSession)
    numbered = dealt(docs.select(id_col, text_col), text_col, group_bytes)
    found = jaccard_components(numbered, id_col, text_col, group_bytes=group_bytes, **options)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES, **options) -> DataFrame:
    """The rows of docs, all columns unchanged, with the smallest id of each component (null ids last, then the first row);
    rows without words all stay."""
    bounded_batches(docs.sparkSession)
    numbered = dealt(docs, text_col, group_bytes)
    found = jaccard_components(numbered, id_col, text_col, group_bytes=group_bytes, **options)
    found = written(found.select("row", "id", "class"), "classes")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    kept = found.groupBy("class").agg(first).select(F.col("first.row").alias("row"))
    copies = written(found.join(kept, "row", "left_anti").select(F.col("row").alias(ROW)), "copies")
    return without_rows(numbered, copies).select(*[F.col(f"`{c}`") for c in docs.columns])

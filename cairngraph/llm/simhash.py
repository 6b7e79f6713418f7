"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint is eight positional bytes. Two fingerprints that differ in at most two bits share at
least six of them: six is the guaranteed minimum of matches. Of the first seven positions such a pair
shares at least five, so the postings are keyed by five of these seven at once (21 ways to choose them)
and every such pair meets in a list. A list only says that five bytes are shared: the positional bytes
that a pair of its members shares are tallied over the whole fingerprint, pairs below six are dropped,
and the differing bits of the others are verified.

Three bytes stay open in a list, which bounds it to 2^24 distinct members whatever the corpus. A list
of more than SMALL members is indexed once more by each open byte (a pair needs one of the three to
reach six), and a member looks up the at most 136 values within two bits of the two bytes left.

Equal fingerprints collapse before the index, so groups of copies cost one entry. A list hands on a
path through each set of linked members, never all pairs. Components come from label hooking and
pointer jumping over those links in DataFrame joins; each round is written to the shared folder.

Defined cases: a null text or one without words has fingerprint zero, linked like any other; fewer
words than a shingle: the whole sequence is the one shingle; a null id takes part with its
fingerprint but is never a component's name (null if a component has no other id); repeated ids stay
separate rows; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairngraph.llm.common import blank_words, drop, map_arrow, texts, written

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
POSITIONS = 8
#: Positional bytes that two fingerprints within MAX_BITS are sure to share.
LEAST_SHARED = POSITIONS - MAX_BITS
#: Positions that a list's key holds, and the ways to choose them among the first (held + MAX_BITS).
HELD = LEAST_SHARED - 1
WAYS = tuple(combinations(range(HELD + MAX_BITS), HELD))
_OPEN = tuple(tuple(p for p in range(POSITIONS) if p not in held) for held in WAYS)
#: Members up to which all pairs of a list are tallied at once.
SMALL = 256
#: Shingles whose bits are summed at once.
BLOCK = 1 << 18

#: All 16-bit values with one or two bits.
_NEAR = np.array(sorted({(1 << a) | (1 << b) for a in range(16) for b in range(16)}), np.int64)


def fingerprint(text: bytes | None, k: int = SHINGLE_WORDS) -> int:
    """SimHash of the k-word shingles, repeats included; each bit by majority of their XXH64."""
    words = blank_words((text or b"").lower())
    if not words:
        return 0
    if len(words) <= k:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        block = hashes[i : i + BLOCK]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tally of the positional bytes that two arrays of fingerprints share."""
    x = (a ^ b).astype(np.uint64)
    return sum(((x >> np.uint64(8 * p)) & np.uint64(255)) == 0 for p in range(POSITIONS))


def tallied(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs reach the least number of shared bytes and then differ in at most MAX_BITS bits."""
    kept = shared_bytes(a, b) >= LEAST_SHARED
    kept[kept] = np.bitwise_count(a[kept] ^ b[kept]) <= MAX_BITS
    return kept


def _byte(members: np.ndarray, p: int) -> np.ndarray:
    return ((members >> np.uint64(8 * p)) & np.uint64(255)).astype(np.int64)


def _small_pairs(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.triu_indices(len(members), 1)
    good = tallied(members[i], members[j])
    return i[good], j[good]


def _pairs_sharing(members: np.ndarray, p: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of members that differ at the positions p and q only: at most 65,536 members."""
    if len(members) <= SMALL:
        return _small_pairs(members)
    rest = _byte(members, p) | (_byte(members, q) << 8)
    place = np.full(65536, -1, np.int64)
    place[rest] = np.arange(len(members))
    found = place[rest[:, None] ^ _NEAR[None, :]]
    i, m = np.nonzero(found > np.arange(len(members))[:, None])
    j = found[i, m]
    good = tallied(members[i], members[j])
    return i[good], j[good]


def posting_pairs(members: np.ndarray, open_: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs, as places, of one posting list: distinct fingerprints that agree but for the open positions."""
    if len(members) <= SMALL:
        return _small_pairs(members)
    out = []
    for p in open_:
        value = _byte(members, p)
        order = np.argsort(value, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(value[order])) + 1):
            if len(part) > 1:
                i, j = _pairs_sharing(members[part], *(q for q in open_ if q != p))
                out.append((part[i], part[j]))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def posting_links(members: np.ndarray, open_: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """A path through each linked set of a posting list."""
    members = np.sort(members)
    i, j = posting_pairs(members, open_)
    root = np.arange(len(members))
    while len(i):
        low = root.copy()
        np.minimum.at(low, root[i], root[j])
        np.minimum.at(low, root[j], root[i])
        low = low[low]
        new = low[root]
        if (new == root).all():
            break
        root = new
    order = np.lexsort((members, root))
    follows = root[order][1:] == root[order][:-1]
    return members[order[:-1][follows]], members[order[1:][follows]]


def row_mark(doc_id: Column, text: Column) -> Column:
    """SHA-256 of the id and the text: equal for equal rows, nulls told apart from empty texts."""
    return F.sha2(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.concat(F.lit("="), text), F.lit(""))), 256)


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", marked: bool = False) -> DataFrame:
    """id and fp (the 64 bits as a signed long) of every row, and mark, the row's, if asked for."""
    body, at = F.col(f"`{text}`").cast("string"), F.col(f"`{doc_id}`").cast("long")
    src = df.select(body.alias("__text"), at.alias("id"), *([row_mark(at, body).alias("mark")] if marked else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t) for t in texts(batch, 0)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(fp.view(np.int64)), *batch.columns[2:]], ["id", "fp", *batch.schema.names[2:]])

    return map_arrow(src, run, "id bigint, fp bigint" + ", mark string" * marked)


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): paths through the linked fingerprints of every posting list; nodes: distinct fp.

    The nodes are dealt anew first: read from few files, they would be exploded by few tasks."""
    spark = nodes.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    entries = []
    for n, held in enumerate(WAYS):
        mask = sum(0xFF << (8 * p) for p in held)
        entries.append(F.struct(F.lit(n).cast("byte").alias("way"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("bytes")))
    lists = (
        nodes.select("fp").repartition(tasks, "fp")
        .select("fp", F.explode(F.array(*entries)).alias("e"))
        .groupBy("e.way", "e.bytes")
        .agg(F.collect_list("fp").alias("members"))
        .where(F.size("members") > 1)
        .select("way", "members")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ways, lists = batch.column(0).to_pylist(), batch.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            ends = np.cumsum(sizes)
            two = (ends - 2)[sizes == 2]  # most lists: tallied all at once
            good = tallied(values[two], values[two + 1])
            out = [(values[two][good], values[two + 1][good])]
            for k in np.flatnonzero(sizes > 2):
                out.append(posting_links(values[ends[k] - sizes[k] : ends[k]], _OPEN[ways[k]]))
            a, b = (np.concatenate([x[n] for x in out]).view(np.int64) for n in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return map_arrow(lists, run, "a bigint, b bigint").distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> tuple[DataFrame, list[str]]:
    """(node, root) of every node of edges(a, b), root being the least node of its component.

    Each round hooks a tree's root to the least grandparent seen from it and halves the paths; rounds
    grow with the logarithm of the longest path. Degrees are small (links() gives paths), and the
    joins on parents, which can be hot, have both sides dealt by the join itself, so that adaptive
    execution splits them. Returns the folders that the result reads."""
    spark = edges.sparkSession
    both, both_at = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    now, now_at = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "roots")
    for _ in range(max_rounds):
        up, up_at = written(
            now.join(now.select(F.col("node").alias("root"), F.col("root").alias("grand")), "root").select("node", "root", "grand"), "grand"
        )
        seen = both.join(up.select(F.col("node").alias("b"), F.col("grand").alias("g")), "b").groupBy("a").agg(F.min("g").alias("least"))
        met, met_at = written(up.join(seen.withColumnRenamed("a", "node"), "node").select("node", "root", "grand", "least"), "met")
        hooks, hooks_at = written(met.groupBy("root").agg(F.min("least").alias("hook")).withColumnRenamed("root", "node"), "hooks")
        new = met.join(hooks, "node", "left").select(
            "node", F.least("root", "grand", "least", "hook").alias("root"), (F.least("root", "grand", "least", "hook") < F.col("root")).alias("moved")
        )
        new, new_at = written(new, "roots")
        moved = new.where("moved").limit(1).count()
        drop(spark, now_at, up_at, met_at, hooks_at)
        now, now_at = new.select("node", "root"), new_at
        if not moved:
            return now, [now_at, both_at]
    raise RuntimeError("components did not settle")


def placed(docs: DataFrame, least: Column) -> tuple[DataFrame, str]:
    """fp, root (the least fingerprint of its component) and the aggregate `least` of every fingerprint of docs(id, fp),
    and the folder that holds them."""
    spark = docs.sparkSession
    nodes, nodes_at = written(docs.groupBy("fp").agg(least.alias("least")), "nodes")
    edges, edges_at = written(links(nodes), "edges")
    roots, roots_at = components(edges)
    drop(spark, edges_at)
    out, out_at = written(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "placed")
    drop(spark, nodes_at, *roots_at)
    return out, out_at


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least doc_id reachable) of every row."""
    spark = df.sparkSession
    docs, _ = written(fingerprints(df, doc_id, text), "fingerprints")
    nodes, nodes_at = placed(docs, F.min("id"))
    names, names_at = written(nodes.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    named, _ = written(nodes.join(names, "root").select("fp", "component_id"), "named")
    drop(spark, nodes_at, names_at)
    return docs.join(named, "fp").select(
        F.col("id").alias(doc_id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of df for each component: that of the least doc_id (null comes last), among equal ids that of the
    least mark. Rows are told apart by id and text, so repeated and null ids take part like any other.

    The join back and the removal of repeated rows share the key, and with it one shuffle of the rows."""
    docs, docs_at = written(fingerprints(df, doc_id, text, True), "fingerprints")
    nodes, nodes_at = placed(docs, F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "mark")))
    kept, _ = written(nodes.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.mark").alias("__mark")), "kept")
    drop(df.sparkSession, docs_at, nodes_at)
    rows = df.toDF(*(f"c{n}" for n in range(len(df.columns))))
    at, body = (F.col(f"c{df.columns.index(c)}") for c in (doc_id, text))
    rows = rows.withColumn("__mark", row_mark(at.cast("long"), body.cast("string")))
    found = rows.join(kept, "__mark", "left_semi").dropDuplicates(["__mark"])
    return found.select(*(F.col(f"c{n}").alias(c) for n, c in enumerate(df.columns)))

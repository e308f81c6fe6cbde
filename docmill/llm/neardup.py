"""Problem 2: near-duplicate records.

Method: chosen-path join on minwise tokens. A set's tokens are its minwise hashes, one for each of PLACES hash functions, of
which two sets share as large a part as their similarity. In every run a set follows one path: at each node a place is
sampled by the node's own hash, so that all sets at a node split on the same shared token. A path ends when the
frequencies of its tokens let its bucket be expected small enough for brute force; a bucket that turns out too large is
split again. Within buckets, sketches of one bit for each minwise hash are compared; pairs whose sketches agree are
checked on their tokens. Runs are repeated until the recall, estimated for each band of similarity from how often the
pairs found were found, reaches the target.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.session import cut, half_even, lookup_join

#: A path ends when this many sets are expected in its bucket; buckets up to BUCKET sets are compared as a whole.
EXPECTED, BUCKET = 192, 3000
#: Splits of a path at most, and further splits of a bucket after which what is left of it is compared in blocks.
DEPTH, AGAIN = 12, 3
#: Minwise hashes of a set (bits of its sketch), and how many of them paths may split on: the same number at each depth.
BITS, PLACES = 256, 96
#: How many standard deviations a pair at the threshold may fall short in its sketch.
SLACK = 4.5
#: Tokens that a smaller share of the sets holds count as this frequent; so the table of frequent ones is bounded.
RARE = 1 / 2000
#: Runs of a round at least and at most, rounds at most, and the recall of each band of similarity at which no further round is made.
RUNS, ROUNDS, RECALL = (12, 64), 6, 0.999
#: Width of a band of similarity.
BAND = 0.05


def word_set(*columns: Column) -> Column:
    """Distinct ids of the runs of [a-z0-9] in the lower-cased columns, joined by a space; null counts as empty."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.xxhash64(w))))


def classes(df: DataFrame, key: str, tokens: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with equal token sets as one class: (members: key, class_id), (sets: class_id, tokens, n_tokens).

    class_id is the smallest key of the class. Empty sets are similar to nothing and belong to no class.
    """
    rows = df.select(F.col(key).alias("key"), tokens.alias("tokens")).where("key is not null and size(tokens) > 0").withColumn("print", F.struct(F.xxhash64("tokens"), F.hash("tokens"), F.size("tokens")))
    rows = cut(rows.distinct())
    firsts = rows.groupBy("print").agg(F.min("key").alias("class_id"))
    members = rows.select("key", "print").join(firsts, "print").select("key", "class_id").distinct()
    sets = rows.join(firsts, [rows["print"] == firsts["print"], rows["key"] == firsts["class_id"]], "left_semi").select(F.col("key").alias("class_id"), "tokens", F.size("tokens").alias("n_tokens"))
    return members, sets


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _minwise(tokens: pa.ListArray) -> np.ndarray:
    """The BITS minwise hashes (32 bits) of each set of a batch; sets aren't empty."""
    rng = np.random.default_rng(11)
    odd = rng.integers(0, 1 << 63, BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 1 << 63, BITS, dtype=np.uint64)
    flat, start = tokens.flatten().to_numpy().view(np.uint64), tokens.offsets.to_numpy()
    start = (start - start[0])[:-1]
    out = np.empty((BITS, len(tokens)), np.uint32)
    for k in range(BITS):
        out[k] = np.minimum.reduceat(((flat * odd[k] + plus[k]) >> np.uint64(32)).astype(np.uint32), start)
    return out


def _sketches(minwise: np.ndarray) -> list[pa.Array]:
    """A set's sketch as BITS / 64 longs: the highest bit of a mixed minwise hash each."""
    bits = ((minwise * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)
    packed = np.ascontiguousarray(np.packbits(bits, axis=0).T).view(np.int64)
    return [pa.array(np.ascontiguousarray(packed[:, k])) for k in range(packed.shape[1])]


SKETCH = [f"s{k}" for k in range(BITS // 64)]
FRONT = "node long, class_id long, n_tokens int, " + ", ".join(f"{c} long" for c in SKETCH)


def _places(run: np.ndarray, node: np.ndarray, depth: int) -> np.ndarray:
    """The place that each node splits on: places are dealt to depths anew in each run, so no path meets a place twice."""
    each = PLACES // DEPTH
    order = np.stack([np.random.default_rng(1000 + r).permutation(PLACES) for r in range(int(run.max()) + 1)]) if len(run) else np.zeros((1, PLACES), int)
    return order[run, (depth % DEPTH) * each + (_mix(node ^ np.uint64(depth)) >> np.uint64(33)).astype(np.int64) % each]


def _step(node: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The node below for a token; its lowest eight bits stay, as they hold the run."""
    return (_mix(node * np.uint64(3) + token.astype(np.uint64)) & ~np.uint64(255)) | (node & np.uint64(255))


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Minwise tokens of the sets of a task by place, those of its share RARE of the sets or more, with their numbers."""
    for batch in batches:
        places, values, counts = [], [], []
        for first in range(0, batch.num_rows, 4000):
            minwise = _minwise(batch.column(0).slice(first, 4000))[:PLACES]
            for k in range(PLACES):
                v, n = np.unique(minwise[k], return_counts=True)
                keep = n > max(1, minwise.shape[1] * RARE)
                places.append(np.full(int(keep.sum()), k, np.int32))
                values.append(v[keep])
                counts.append(n[keep])
        if places:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(places)), pa.array(np.concatenate(values).astype(np.int64)), pa.array(np.concatenate(counts).astype(np.int64))], names=["place", "v", "n"])


def _paths(batches: Iterator[pa.RecordBatch], runs: range, known: np.ndarray, logs: np.ndarray, goal: float) -> Iterator[pa.RecordBatch]:
    """The bucket of each set in each run: node, class_id, n_tokens and sketch."""
    rare = math.log(RARE)
    for whole in batches:
        for begin in range(0, whole.num_rows, 1000):
            batch = whole.slice(begin, 1000)
            minwise = _minwise(batch.column(1))
            sets = batch.num_rows
            cost = np.full((PLACES, sets), rare)
            if len(known):
                code = (np.arange(PLACES, dtype=np.uint64)[:, None] << np.uint64(32)) | minwise[:PLACES]
                at = np.minimum(np.searchsorted(known, code), len(known) - 1)
                cost = np.where(known[at] == code, logs[at], rare)
            run, owner = np.repeat(np.array(runs, np.int64), sets), np.tile(np.arange(sets), len(runs))
            node = (_mix(run.astype(np.uint64) + np.uint64(1)) & ~np.uint64(255)) | (run % 256).astype(np.uint64)
            chance, live = np.zeros(len(run)), np.arange(len(run))
            for depth in range(DEPTH):
                live = live[chance[live] > goal]
                if not len(live):
                    break
                place = _places(run[live], node[live], depth)
                node[live] = _step(node[live], minwise[place, owner[live]])
                chance[live] += cost[place, owner[live]]
            rows = pa.array(owner)
            sketch = [c.take(rows) for c in _sketches(minwise)]
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), batch.column(0).take(rows), batch.column(2).take(rows), *sketch], names=["node", "class_id", "n_tokens", *SKETCH])


def _further(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
    """One more split of the sets of buckets that are too large."""
    for whole in batches:
        for begin in range(0, whole.num_rows, 4000):
            batch = whole.slice(begin, 4000)
            minwise = _minwise(batch.column(2))
            node = batch.column(0).to_numpy().view(np.uint64)
            place = _places((node & np.uint64(255)).astype(np.int64), node, turn)
            below = _step(node ^ (np.uint64(turn + 1) << np.uint64(40)), minwise[place, np.arange(len(node))])
            yield pa.RecordBatch.from_arrays([pa.array(below.view(np.int64)), *(batch.column(k) for k in (1, *range(3, batch.num_columns)))], names=["node", "class_id", "n_tokens", *SKETCH])


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs within each bucket whose sizes and sketches allow the threshold; in a bucket of two parts only pairs between them."""
    expected = (1 + threshold) / 2
    enough = 2 * BITS * (expected - SLACK * (expected * (1 - expected) / BITS) ** 0.5) - BITS
    for batch in batches:
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        rows = batch.column(0).flatten()
        ends = np.cumsum(np.diff(batch.column(0).offsets.to_numpy()))
        ids, part, size = (rows.field(c).to_numpy() for c in ("class_id", "part", "n_tokens"))
        words = np.stack([rows.field(c).to_numpy() for c in SKETCH], axis=1)
        for first, end in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist()):
            bits = np.unpackbits(words[first:end].view(np.uint8), axis=1).astype(np.float32) * 2 - 1
            for a in range(0, end - first, 1000):
                i, j = np.nonzero(bits[a : a + 1000] @ bits[a:].T >= enough)
                i, j = i[i < j] + first + a, j[i < j] + first + a
                keep = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-6
                if part[first:end].any():
                    keep &= part[i] != part[j]
                left.append(np.minimum(ids[i], ids[j])[keep])
                right.append(np.maximum(ids[i], ids[j])[keep])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])


def _round(sets: DataFrame, threshold: float, runs: range, known: np.ndarray, logs: np.ndarray, goal: float, bucket: int, again: int) -> DataFrame:
    """Candidate pairs a, b of a round and the number of its runs that found them."""
    front = sets.mapInArrow(lambda it: _paths(it, runs, known, logs, goal), FRONT)
    parts = []
    for turn in range(again + 1):
        large = cut(front.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket))
        if large.isEmpty():
            parts.append(front.withColumn("part", F.lit(0)))
            break
        sized = lookup_join(front, large, "node")
        parts.append(sized.where("n is null").drop("n").withColumn("part", F.lit(0)))
        rest = sized.where("n is not null")
        if turn == again:  # what can't be split is compared in blocks, each with itself and with every other one
            rest = rest.withColumn("blocks", F.ceil(F.col("n") / max(1, bucket // 2)).cast("int")).withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
            rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
            part = F.when(F.col("low") == F.col("high"), 0).when(F.col("block") == F.col("low"), 1).otherwise(2)
            parts.append(rest.select(F.xxhash64("node", "low", "high").alias("node"), "class_id", "n_tokens", *SKETCH, part.alias("part")))
        else:
            more = rest.select("node", "class_id", *SKETCH).join(sets, "class_id").select("node", "class_id", "tokens", "n_tokens", *SKETCH)
            front = cut(more.mapInArrow(lambda it, turn=turn: _further(it, turn), FRONT))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    buckets = rows.groupBy("node").agg(F.collect_list(F.struct("class_id", "n_tokens", *SKETCH, "part")).alias("bucket")).where("size(bucket) > 1")
    return buckets.select("bucket").mapInArrow(lambda it: _compare(it, threshold), "a long, b long").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_runs"))


def _verified(candidates: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Candidates with n_shared, n_union (null where these don't reach the threshold), each side looked up once."""
    a, b = (sets.select(F.col("class_id").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab")
    met = lookup_join(lookup_join(candidates, a, "a"), b, "b", counted=candidates.select("b"))
    met = met.select("a", "b", "n_runs", F.size(F.array_intersect("ta", "tb")).alias("n_shared"), (F.size("ta") + F.size("tb")).alias("both"))
    met = met.select("a", "b", "n_runs", "n_shared", (F.col("both") - F.col("n_shared")).alias("n_union"))
    return met.where(F.col("n_shared") >= F.col("n_union") * threshold - 1e-6)


def _missed(pairs: DataFrame) -> list[tuple[int, float]]:
    """(pairs found, pairs that no run found) of each band of similarity, by the numbers found in one and in two runs (Chao)."""
    band = F.floor(F.col("n_shared") / F.col("n_union") / BAND + 1e-9)
    counts = pairs.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_runs") == 1).alias("once"), F.count_if(F.col("n_runs") == 2).alias("twice"))
    return [(r["n"], r["once"] * (r["once"] - 1) / (2 * (r["twice"] + 1))) for r in counts.collect()]  # at most 1 / BAND + 1 rows


def similar_classes(sets: DataFrame, threshold: float, recall: float = RECALL, rounds: int = ROUNDS, bucket: int = BUCKET, again: int = AGAIN, expected: float = EXPECTED) -> DataFrame:
    """a, b, n_shared, n_union of every two classes whose Jaccard similarity is at least the threshold (a < b).

    A round has as many runs as a pair at the threshold needs for the recall at the mean length of a path. Rounds are
    repeated until, in each band of similarity, the pairs estimated to be missed are less than one in two or their share
    is at most 1 - recall; it is an error if `rounds` rounds don't reach that. As many sets as one bucket may hold are compared at once.
    """
    sets = cut(sets.select("class_id", "tokens", "n_tokens"))
    n = sets.count()
    goal = -math.log(max(1.0, n / expected)) - 1e-9
    if n <= min(expected, bucket):
        return _verified(cut(_round(sets, threshold, range(1), np.empty(0, np.uint64), np.empty(0), 0.0, bucket, again)), sets, threshold).drop("n_runs")
    often = sets.select("tokens").mapInArrow(_frequent, "place int, v long, n long").groupBy("place", "v").agg(F.sum("n").alias("n")).where(F.col("n") > n * RARE).collect()  # at most PLACES / RARE
    table = sorted((r["place"] << 32 | r["v"], r["n"] / n) for r in often)
    tokens, share = np.array([t for t, _ in table], np.uint64), np.array([c for _, c in table])
    logs = np.log(share)
    fall = -(share @ logs + (PLACES - share.sum()) * math.log(RARE)) / PLACES  # mean fall of a path's log frequency at each split
    depth = max(1.0, min(DEPTH, -goal / fall) + 0.5)
    runs = min(max(math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth)), RUNS[0]), RUNS[1])
    found = None
    for k in range(rounds):
        now = cut(_round(sets, threshold, range(k * runs, (k + 1) * runs), tokens, logs, goal, bucket, again))
        if found is None:
            found = cut(_verified(now, sets, threshold))
        else:
            seen = now.join(found.select("a", "b"), ["a", "b"], "left_semi").select("a", "b", F.col("n_runs").alias("more"))
            new = _verified(now.join(found.select("a", "b"), ["a", "b"], "left_anti"), sets, threshold)
            old = found.join(seen, ["a", "b"], "left").withColumn("n_runs", F.col("n_runs") + F.coalesce("more", F.lit(0))).drop("more")
            found = cut(old.unionByName(new))
        if all(missed < 0.5 or missed <= (1 - recall) * (some + missed) for some, missed in _missed(found)):
            return found.drop("n_runs")
    raise RuntimeError(f"near-duplicates: {rounds} rounds of {runs} runs don't reach a recall of {recall} in each band; raise rounds")


def groups(links: DataFrame, members: DataFrame, max_rounds: int = 60) -> DataFrame:
    """key, class_id, group_id and n_links (of the class, to other classes) of every member.

    Groups are the connected components of the links; group_id is the smallest class_id of the group. Labels spread
    along links, and from each label's own label (pointer jumping), so long chains take few rounds.
    """
    edges = links.select("a", "b")
    edges = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    nodes = members.select("class_id").distinct()
    degree = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n_links"))
    label = cut(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("class_id"), F.least("a", "m").alias("label")))
    for _ in range(max_rounds):
        near = edges.join(label.withColumnRenamed("class_id", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        step = label.join(near.withColumnRenamed("a", "class_id"), "class_id", "left").select("class_id", "label", F.least("label", F.coalesce("m", "label")).alias("new"))
        jump = step.select(F.col("class_id").alias("new"), F.col("new").alias("far"))
        both = cut(step.join(jump, "new", "left").select("class_id", "label", F.least("new", F.coalesce("far", "new")).alias("new")))
        changed = both.where("new <> label").isEmpty()
        label = both.select("class_id", F.col("new").alias("label"))
        if changed:
            break
    else:
        raise RuntimeError("groups did not settle; raise max_rounds")
    out = nodes.join(label, "class_id", "left").join(degree.withColumnRenamed("a", "class_id"), "class_id", "left")
    return members.join(out, "class_id").select("key", "class_id", F.coalesce("label", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_duplicates(df: DataFrame, key: str, columns: list[str], threshold: float) -> tuple[DataFrame, DataFrame]:
    """(members: key, class_id), (links: a, b, n_shared, n_union between classes) of the word sets of columns.

    Keys are longs; rows with a null key are left out, repeats count once. Rows without a word belong to no class.
    """
    members, sets = classes(df.withColumn("_key", F.col(key).cast("long")), "_key", word_set(*[F.col(c) for c in columns]))
    return members, similar_classes(sets, threshold)


def pairs(members: DataFrame, links: DataFrame, part: int = 500) -> DataFrame:
    """key_a < key_b and similarity of all pairs of rows: rows of linked classes, and rows of one class.

    Classes are dealt out in parts of about `part` rows, each an array; a part of one class meets a part of another in
    one row. So a class that holds a large share of the rows is many rows on both sides, and no task makes all its pairs.
    """
    sizes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    large = cut(sizes.where(F.col("n") > part).select("class_id", F.ceil(F.col("n") / part).cast("int").alias("parts")))
    some = not large.isEmpty()

    def with_parts(df: DataFrame, column: str, name: str) -> DataFrame:
        if not some:
            return df.withColumn(name, F.lit(1))
        return lookup_join(df, large.select(F.col("class_id").alias(column), F.col("parts").alias(name)), column).fillna(1, [name])

    dealt = with_parts(members, "class_id", "parts").select("class_id", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("p"), "key")
    lists = dealt.groupBy("class_id", "p").agg(F.collect_list("key").alias("keys")).select(F.struct("class_id", "p").alias("cell"), "keys")
    one = sizes.where("n > 1").select(F.col("class_id").alias("a"), F.col("class_id").alias("b"), F.lit(1.0).alias("similarity"))
    two = links.select("a", "b", (F.col("n_shared") / F.col("n_union")).alias("similarity"))
    met = with_parts(with_parts(two.unionByName(one), "a", "parts_a"), "b", "parts_b")
    cells = met.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts_a") - 1))).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts_b") - 1))).where("a <> b or p <= q")
    cells = cut(cells.select(F.struct(F.col("a").alias("class_id"), "p").alias("left"), F.struct(F.col("b").alias("class_id"), F.col("q").alias("p")).alias("right"), "similarity"))
    full = cells
    for side in ("left", "right"):
        full = lookup_join(full, lists.select(F.col("cell").alias(side), F.col("keys").alias(f"{side}_keys")), side, counted=cells.select(side))
    rows = full.select("similarity", "left", "right", F.explode("left_keys").alias("x"), "right_keys").select("similarity", "left", "right", "x", F.explode("right_keys").alias("y"))
    rows = rows.where("left <> right or x < y")
    return rows.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"), half_even(F.col("similarity"), 6).alias("similarity"))

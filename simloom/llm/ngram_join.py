"""N-gram Jaccard join with prefix trees.

A document's set is its distinct k-word shingles (64-bit hashes). Two documents link when the
Jaccard index of their sets is at least a threshold; the operator returns the components of these
links, exactly: no link between different sets is lost, but links inside a component that is
already known are not looked for.

1. The global order of shingles is: rare ones by hash, then the frequent ones by frequency. Which
   are frequent is counted over all documents, for the low part of the hash range, from which the
   prefixes come. The order only steers how much is compared, never what is found.
2. A set's prefix, its first n - ceil(t n) + 1 shingles, must share one with any partner's prefix.
   Documents with equal sets are one node (the least id), so a large group of copies is one node.
3. Stars: every node is put with the node of least id in the group it shares most prefix shingles
   with, and each star (dealt in parts if large, and then once more in other parts) is clustered:
   walked from node to node, so that a group of near copies costs about one comparison a node.
4. What is left are groups of a prefix shingle whose nodes are in several components. Pairs across
   components are formed where they are few against the group's rows. A pair counts only where the
   shingle could be their first common one: what follows it in the shorter rest must reach the
   least overlap. Candidate pairs meet their shared prefix shingles first: common ones in the
   prefixes and all of the set whose prefix ends first that follows must reach the least overlap.
   Few pairs pass, and only their documents' whole sets are made and moved.
5. The nodes of the other groups (templates, passages in very many documents) are joined anew, with
   shingles counted among them alone. Partners either share a shingle that few of them hold, whose
   group is small, so its pairs are formed; or all they share is frequent. Then the frequent part of
   a set and the set's size decide, so nodes that agree in both are one class and only classes are
   joined, level by level, as long as that leaves at most half as many. Classes that link are linked
   with all of their members. What is left at the end is put together by shared prefix shingles and
   compared block by block, blocks being ranges of sizes dealt by a hash.
6. What is compared is compared by prefix tree: a block's sets are stored in a trie in global order,
   one-child paths in one node; the probing set walks it once, carries its overlap down shared
   paths, and leaves a subtree when the overlap so far and what is left on either side cannot
   reach the least overlap the subtree's sizes ask for. Overlaps are counted, so the result is
   exact for the hashed shingles.

Ids may be of any type that can be ordered; ids that are no integers are numbered in their order.
Rows that share an id are one node. A null id is in no link and has a null component. Null and
empty texts have empty sets and are linked with nothing. Long texts are read whole; a worker holds
CHUNK_BYTES of text, or one text. Repeated rows have equal sets and are one node; of equals the
least id names the component, so there are no ties. Empty tables give empty results. Columns other
than id and text are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import arrow_rows, bounded, materialise, tidied
from .wordhash import Words, chunks, lists

K = 5
PERCENT = 75
#: A shingle in more documents than this is put behind the rare ones; at most MOST_FREQUENT are.
FREQUENT = 40
MOST_FREQUENT = 500_000
#: Share of the hash range in which frequencies are counted.
COUNTED = 0.4
#: Members compared with one probe in one trie, nodes of a block, and nodes that are clustered together.
CHUNK = 256
BLOCK = 128
CLUSTER = 256
#: Rows of an Arrow batch; a row may hold a long text or a large set.
ARROW_ROWS = 1000
#: Pairs a row up to which a group's pairs are formed.
PAIRS_A_ROW = 64
#: A prefix shingle of more rows than this is hot, if it stands in so many rows of an Arrow batch.
HOT_ROWS = 20_000
IN_A_BATCH = 4
#: Classes are joined anew while they are at most this share of the nodes they stand for.
FEWER = 0.5

_LOW = -(1 << 63)


def least_overlap(n: np.ndarray | int, m: np.ndarray | int, percent: int = PERCENT):
    """Least intersection of sets of n and m whose Jaccard index is percent or more."""
    return -(-(n + m) * percent // (100 + percent))


class PrefixTree:
    """Sorted sets (int64 arrays) in a trie with one-child paths joined.

    sizes are those of the whole sets where only parts of them are stored.
    """

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT, sizes: list[int] | None = None):
        self.percent = percent
        keys = [(s.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").tobytes() for s in sets]
        order = sorted(range(len(sets)), key=keys.__getitem__)
        # Node: [segment, children, least size, greatest size, own members, greatest length]
        root: list = [np.zeros(0, np.int64), [], None, None, [], 0]
        path: list[tuple[int, list]] = [(0, root)]  # (depth at the node's end, node)
        before: np.ndarray | None = None
        for i in order:
            s = sets[i]
            shared = 0
            if before is not None:
                n = min(len(before), len(s))
                differ = np.flatnonzero(before[:n] != s[:n])
                shared = int(differ[0]) if len(differ) else n
            while path[-1][0] > shared and path[-2][0] >= shared:
                path.pop()
            depth, node = path[-1]
            if depth > shared:  # cut the node's segment
                above = path[-2][0]
                lower = [node[0][shared - above :], *node[1:]]
                node[0], node[1], node[4] = node[0][: shared - above], [lower], []
                path[-1] = (shared, node)
            if len(s) > shared:
                leaf: list = [s[shared:], [], None, None, [i], 0]
                path[-1][1][1].append(leaf)
                path.append((len(s), leaf))
            else:
                path[-1][1][4].append(i)
            before = s
        self.root, self.lengths = root, [len(s) for s in sets]
        self.sizes = self.lengths if sizes is None else sizes
        self._bounds()

    def _bounds(self) -> None:
        stack, post = [self.root], []
        while stack:
            node = stack.pop()
            post.append(node)
            stack += node[1]
        for node in reversed(post):
            own, below = node[4], node[1]
            node[2] = min([self.sizes[i] for i in own] + [c[2] for c in below], default=0)
            node[3] = max([self.sizes[i] for i in own] + [c[3] for c in below], default=0)
            node[5] = max([self.lengths[i] for i in own] + [c[5] for c in below], default=0)

    def matches(self, x: np.ndarray, wanted: bytearray | None = None, size: int | None = None) -> list[int]:
        """Members (of those wanted) whose Jaccard index with x (sorted, not empty) is percent or more.

        size is that of the whole set of which x is a part; what x and a member share is all that their whole sets do.
        """
        found, length, percent = [], len(x), self.percent
        n = length if size is None else size
        stack = [(self.root, 0, 0)]  # node, overlap and depth above it
        while stack:
            node, overlap, depth = stack.pop()
            segment, children, least, most, own, longest = node
            if 100 * least > 100 * n * 100 // percent or most * 100 < n * percent:
                continue
            left = length
            if len(segment):
                at = np.searchsorted(x, segment)
                overlap += int(np.count_nonzero(x[np.minimum(at, length - 1)] == segment))
                depth += len(segment)
                left = length - int(at[-1])
            if overlap + min(left, longest - depth) < least_overlap(n, least, percent):
                continue
            found += [i for i in own if (wanted is None or wanted[i]) and overlap >= least_overlap(n, self.sizes[i], percent)]
            stack += [(c, overlap, depth) for c in children]
        return found


def cluster(nodes: list[tuple[int, int | None, int, np.ndarray]], percent: int = PERCENT) -> Iterator[tuple[int, int]]:
    """Links between components of nodes (id, component so far, size, set) that make them whole.

    A component is walked from its first node: each node asks the trie of those not reached yet,
    and whom it finds joins the walk with all of its component (a null component is the node
    alone). The trie is built anew when half of its members are reached, so in a group of near
    copies, where the first walks reach nearly all, the others ask small tries.
    """
    together: dict[int, list[int]] = {}
    for i, (_, c, _, _) in enumerate(nodes):
        if c is not None:
            together.setdefault(c, []).append(i)
    waiting = bytearray(b"\x01" * len(nodes))
    left = len(nodes)
    members: list[int] = []
    tree = None
    alive = bytearray()
    place: dict[int, int] = {}
    frontier: list[int] = []

    def reach(i: int) -> None:
        nonlocal left
        for j in (i,) if nodes[i][1] is None else together[nodes[i][1]]:
            if waiting[j]:
                waiting[j] = 0
                left -= 1
                frontier.append(j)
                if j in place:
                    alive[place[j]] = 0

    for start in range(len(nodes)):
        if not waiting[start]:
            continue
        reach(start)
        while frontier:
            at = frontier.pop()
            if not left:
                continue
            if tree is None or left <= len(members) // 2:
                members = [i for i in range(len(nodes)) if waiting[i]]
                tree = PrefixTree([nodes[i][3] for i in members], percent, [nodes[i][2] for i in members])
                alive = bytearray(b"\x01" * len(members))
                place = {i: k for k, i in enumerate(members)}
            for k in tree.matches(nodes[at][3], alive, nodes[at][2]):
                if alive[k]:
                    if nodes[at][0] != nodes[members[k]][0]:
                        yield nodes[at][0], nodes[members[k]][0]
                    reach(members[k])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _frequent(parts: DataFrame, frequent: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles ascending, their counts) of at most `most` shingles counted over `frequent` times. parts: (token, n)."""
    counts = parts.groupBy("token").agg(F.sum("n").alias("n"))
    counts = materialise(counts.filter(F.col("n") > frequent), "shingle-counts")
    while counts.count() > most:  # a higher bar, until the table is known to be small
        frequent *= 4
        counts = counts.filter(F.col("n") > frequent)
    got = counts.toPandas().sort_values("token")
    return got["token"].to_numpy(np.int64), got["n"].to_numpy(np.int64)


def _counted(sets: list[np.ndarray]) -> pa.RecordBatch:
    token, count = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.int64), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(token), pa.array(count.astype(np.int32))], ["token", "n"])


def frequent_shingles(texts: DataFrame, k: int, frequent: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles ascending, their document counts) of at most `most` shingles in over `frequent` documents."""
    limit = np.int64(_LOW + int(COUNTED * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, starts in chunks(batch, 0):
                yield _counted([s[: np.searchsorted(s, limit)] for s in Words(data, starts).shingles(k)])

    return _frequent(texts.select("text").mapInArrow(run, "token long, n int"), frequent, most)


def prefix_of(s: np.ndarray, common: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The first len(s) - ceil(percent len(s)) + 1 shingles of s in global order, and the last one's count (0: rare)."""
    n = len(s)
    p = n - -(-n * percent // 100) + 1
    cold, late, often = split_by(s, common, counts)
    if not n or len(cold) >= p:
        return (cold[:p] if n else s), 0
    order = np.lexsort((late, often))[: p - len(cold)]
    return np.concatenate((cold, late[order])), int(often[order[-1]])


def split_by(s: np.ndarray, common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rare shingles of s, frequent ones, their counts)."""
    if not len(s) or not len(common):
        return s, s[:0], s[:0]
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    hot = common[at] == s
    return s[~hot], s[hot], counts[at[hot]]


def digests(s: np.ndarray) -> tuple[int, int]:
    """Two sums over hashed members, which tell sets apart (with their size)."""
    return int(s.sum()), int((s * (s | np.int64(1)) ^ (s >> np.int64(29))).sum())


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id each id of edges (a, b) is connected with.

    Labels spread over edges and are short-cut through their own labels in each round, so rounds
    grow with the logarithm of a component's width. Each round is stored in the shared folder.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(both, "links")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        spread = labels.join(near, "id").select("id", F.least("component", "near").alias("new"), F.col("component").alias("old"))
        up = labels.select(F.col("id").alias("new"), F.col("component").alias("up"))
        spread = materialise(spread.join(up, "new").select("id", F.least("new", "up").alias("component"), "old"), "labels")
        if spread.filter("component < old").isEmpty():
            return spread.select("id", "component")
        labels = spread.select("id", "component")


def _sets_of(texts: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(id, n, set) of the texts whose id is in wanted (id), a stored table."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, starts in chunks(batch, 1):
                sets = Words(data, starts).shingles(k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), lists(sets)], ["id", "n", "set"])

    return texts.join(bounded(wanted), "id", "left_semi").select("id", "text").mapInArrow(whole, "id long, n long, set array<long>")


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """The lists of an Arrow list<int64> column, an empty one for null."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _compare(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) in each group of groups (g, side, id, c): side 0 probes side 1, side 2 is clustered.

    groups is a stored table; c is the component known so far. sets: (id, n, set), n the size of the whole set.
    Rows come sorted by group and side; a worker holds one group, whose size its maker bounds.
    """
    rows = sets.join(bounded(groups), "id").select("g", "side", "id", "c", "n", "set").repartition("g").sortWithinPartitions("g", "side")

    def links(probes: list, members: list, others: list) -> Iterator[tuple[int, int]]:
        if probes and members:
            tree = PrefixTree([m[3] for m in members], percent, [m[2] for m in members])
            for a, _, n, x in probes:
                for i in tree.matches(x, size=n):
                    if members[i][0] != a:
                        yield a, members[i][0]
        yield from cluster(others, percent)

    def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sides = None, ([], [], [])
        for batch in batches:
            out: list[tuple[int, int]] = []
            for g, side, node, c, n, own in zip(*(batch.column(i).to_pylist() for i in range(5)), _arrays(batch.column(5)), strict=True):
                if g != group:
                    out += links(*sides)
                    group, sides = g, ([], [], [])
                sides[side].append((node, c, n, own.copy()))
            yield batch_of(out)
        yield batch_of(list(links(*sides)))

    return rows.mapInArrow(run, "a long, b long")


def _compare_texts(groups: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """_compare with sets made from the texts of the nodes in groups."""
    groups = materialise(groups, "groups")
    wanted = materialise(groups.select("id").distinct(), "wanted")
    return _compare(groups, _sets_of(texts, wanted, k), percent)


def _probe_groups(pairs: DataFrame) -> DataFrame:
    """Groups of pairs (a, b): a probes its partners, at most about CHUNK in a group."""
    pairs = materialise(pairs, "pairs")
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    dealt = pairs.join(sizes, "a").withColumn("g", F.concat_ws(":", "a", F.pmod(F.xxhash64("b"), F.col("parts"))))
    probes = dealt.select("g", F.lit(0).alias("side"), F.col("a").alias("id"), F.col("a").alias("c")).distinct()
    return probes.unionByName(dealt.select("g", F.lit(1).alias("side"), F.col("b").alias("id"), F.col("b").alias("c")))


def _cluster_groups(stars: DataFrame, seed: int, several: bool) -> DataFrame:
    """Groups of a leader and those starred to it, dealt by a hash; only of leaders with more than one if several."""
    sizes = stars.groupBy("a").agg(F.ceil(F.count("*") / CLUSTER).cast("int").alias("parts"))
    if several:
        sizes = sizes.filter("parts > 1")
    dealt = stars.join(sizes, "a").withColumn("g", F.concat_ws(":", "a", F.pmod(F.xxhash64("b", F.lit(seed)), F.col("parts"))))
    leaders = dealt.select("g", F.lit(2).alias("side"), F.col("a").alias("id"), F.col("a").alias("c")).distinct()
    return leaders.unionByName(dealt.select("g", F.lit(2).alias("side"), F.col("b").alias("id"), F.col("b").alias("c")))


def close(n: str, m: str, percent: int):
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def star_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """(a, b): each node b with the leader a of most of its groups."""
    led = posts.filter((F.col("id") != F.col("lead_id")) & close("n", "lead_n", percent)).groupBy("id", "lead_id").agg(F.count("*").alias("times"))
    best = led.groupBy("id").agg(F.max(F.struct(F.col("times"), -F.col("lead_id"))).alias("best"))
    return best.select((-F.col("best.col2")).alias("a"), F.col("id").alias("b"))


def need(n, m, percent: int):
    return F.ceil((n + m) * percent / (100 + percent))


def _likely(pairs: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose prefixes do not rule them out. shared: (id, n, last_f, last_t, tokens, mixed).

    mixed marks ids that rows with different texts share; their pairs all pass.
    """
    left = shared.select(*(F.col(c).alias(f"a_{c}") for c in shared.columns))
    right = shared.select(*(F.col(c).alias(f"b_{c}") for c in shared.columns))
    met = pairs.join(left, pairs["a"] == left["a_id"]).join(right, pairs["b"] == right["b_id"])
    common = F.size(F.array_intersect("a_tokens", "b_tokens"))
    a_first = F.struct("a_last_f", "a_last_t") <= F.struct("b_last_f", "b_last_t")
    # The set whose prefix ends first meets the other one's prefix only up to there.
    rest = F.ceil(F.when(a_first, F.col("a_n")).otherwise(F.col("b_n")) * percent / 100) - 1
    return met.filter(F.col("a_mixed") | F.col("b_mixed") | (common + rest >= need(F.col("a_n"), F.col("b_n"), percent))).select("a", "b")


def _residual(posts: DataFrame, comps: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b), nodes (id, c) of groups with many looks) across components, for posts (token, id, n, at, early).

    Of two partners the smaller one (of equals, either) is early at the shingle: what follows the
    shingle in it reaches the least overlap of two sets of its size. So early rows look at rows that
    are not smaller; rows that are not early are never compared with one another.
    """
    rows = posts.filter("has_early").select("token", "id", "n", "at", "early")
    rows = rows.join(bounded(comps), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    several = rows.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("token")
    rows = rows.join(bounded(materialise(several, "open-tokens")), "token", "left_semi").select("token", "id", "n", "at", "early", "c")
    rows = materialise(rows, "open-groups")
    per = rows.groupBy("token", "c").agg(F.count("*").alias("m"), F.count(F.when(F.col("early"), 1)).alias("e"))
    stats = per.groupBy("token").agg(F.sum("m").alias("rows_"), F.sum("e").alias("e"), F.max(F.struct("m", "c", "e")).alias("big"))
    looks = (F.col("e") - F.col("big.e")) * F.col("rows_") + F.col("big.e") * (F.col("rows_") - F.col("big.m"))
    stats = stats.select("token", "rows_", "e", F.col("big.c").alias("big"), F.col("big.m").alias("big_m"), F.col("big.e").alias("big_e"), (looks <= PAIRS_A_ROW * F.col("rows_")).alias("few"))
    stats = materialise(stats, "open-stats")
    rows = rows.join(stats.select("token", "big", "few"), "token")
    small = rows.filter("few").select("token", "id", "n", "at", "early", "c", "big")
    first = F.least(F.col("l.n") - F.col("l.at"), F.col("r.n") - F.col("r.at")) >= need(F.col("l.n"), F.col("r.n"), percent)
    order = (F.col("l.n") < F.col("r.n")) | ((F.col("l.n") == F.col("r.n")) & (F.col("l.id") < F.col("r.id")))
    on = (F.col("l.token") == F.col("r.token")) & (F.col("l.c") != F.col("r.c")) & order & close("l.n", "r.n", percent) & first
    # Rows of a group's largest component look at the others only.
    minor = small.filter("early and c <> big").alias("l").join(small.alias("r"), on)
    major = small.filter("early and c = big").alias("l").join(small.filter("c <> big").alias("r"), on)
    pairs = minor.select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).unionByName(major.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))).distinct()
    return pairs, rows.filter("not few").groupBy("id").agg(F.min("c").alias("c"))


def _hot_parts(items: DataFrame, percent: int, frequent: int, most: int) -> DataFrame:
    """items (id, c, n, set) with len, prefix (its rare shingles) and, where the prefix goes on among frequent ones, hot.

    hot are all frequent shingles of the set, ordered by value, hot_prefix those of them that the prefix has. Shingles are counted among the items, all of them; at most `most` are known as frequent.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _counted(_arrays(batch.column(0)))

    common = items.sparkSession.sparkContext.broadcast(_frequent(items.select("set").mapInArrow(count, "token long, n int"), frequent, most))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = common.value
        for batch in batches:
            out = {c: [] for c in ("len", "prefix", "hot", "hot_prefix")}
            for n, own in zip(batch.column(2).to_pylist(), _arrays(batch.column(3)), strict=True):
                cold, late, often = split_by(own, tokens, counts)
                p = len(own) - -(-n * percent // 100) + 1
                hot = len(cold) < p
                order = np.lexsort((late, often))[: p - len(cold)] if hot else []
                row = (len(own), cold[: max(p, 0)], late if hot else late[:0], late[order] if hot else late[:0])
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
            made = [pa.array(v, pa.int64()) if c == "len" else lists(v) for c, v in out.items()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *made], ["id", "c", "n", *out])

    schema = "id long, c long, n long, len long, prefix array<long>, hot array<long>, hot_prefix array<long>"
    return materialise(items.select("id", "c", "n", "set").mapInArrow(split, schema), "hot-parts")


def apart(a: str, b: str):
    """Whether two components may differ; null is not one component."""
    return F.coalesce(F.col(a) != F.col(b), F.lit(True))


def _rare_pairs(parts: DataFrame, percent: int) -> DataFrame:
    """(a, b) across components that may have their first common shingle among the rare ones of their prefixes."""
    every = Window.partitionBy("token")
    posts = parts.select("id", "c", "n", "len", F.posexplode("prefix").alias("at", "token"))
    several = (F.min("c").over(every) != F.max("c").over(every)) | ((F.count("*").over(every) > 1) & (F.count("c").over(every) < F.count("*").over(every)))
    posts = materialise(posts.withColumn("several", several).filter("several").drop("several"), "hot-rare")
    order = (F.col("l.n") < F.col("r.n")) | ((F.col("l.n") == F.col("r.n")) & (F.col("l.id") < F.col("r.id")))
    first = F.least(F.col("l.len") - F.col("l.at"), F.col("r.len") - F.col("r.at")) >= need(F.col("l.n"), F.col("r.n"), percent)
    on = (F.col("l.token") == F.col("r.token")) & apart("l.c", "r.c") & order & close("l.n", "r.n", percent) & first
    return posts.alias("l").join(posts.alias("r"), on).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()


def _block_groups(classes: DataFrame, percent: int) -> DataFrame:
    """Groups (g, side, id, c) of classes (id, c, n, hot_prefix): each two blocks that can hold partners, once.

    Classes that share a prefix shingle across components are put together; blocks are ranges of sizes that span a
    factor of 100 / percent, dealt in parts by a hash.
    """
    posts = classes.select("id", "c", F.explode("hot_prefix").alias("token"))
    several = (F.min("c") != F.max("c")) | (F.count("c") < F.count("*"))
    leads = posts.groupBy("token").agg(F.min("id").alias("lead"), F.coalesce(several, F.lit(True)).alias("several")).filter("several").select("token", "lead")
    leads = posts.join(bounded(materialise(leads, "block-leads")), "token").filter("lead <> id")
    found = components(leads.select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct())
    joint = classes.select("id", "c", "n").join(bounded(found.withColumnRenamed("component", "joint")), "id")
    width = math.log(100 / percent)
    joint = joint.withColumn("span", F.floor(F.log(F.col("n").cast("double")) / width).cast("int"))
    parts = joint.groupBy("joint", "span").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    joint = joint.join(bounded(materialise(parts, "block-parts")), ["joint", "span"])
    joint = materialise(joint.withColumn("block", F.concat_ws(".", "span", F.pmod(F.xxhash64("id"), F.col("parts")))), "joint-groups")
    blocks = joint.groupBy("joint", "span", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    x, y = blocks.alias("x"), blocks.alias("y")
    # Partners' spans differ by one at most (two allow for rounding); their sizes then decide.
    order = (F.col("x.span") < F.col("y.span")) | ((F.col("x.span") == F.col("y.span")) & (F.col("x.block") <= F.col("y.block")))
    fit = (F.col("x.joint") == F.col("y.joint")) & order & (F.col("y.span") - F.col("x.span") <= 2) & (F.col("y.lo") * percent <= F.col("x.hi") * 100)
    tasks = x.join(y, fit).select(F.col("x.joint").alias("joint"), F.col("x.block").alias("x"), F.col("y.block").alias("y"))
    tasks = tasks.withColumn("g", F.concat_ws(":", "joint", "x", "y"))
    one = joint.join(tasks.select("g", "joint", F.col("x").alias("block")), ["joint", "block"])
    other = joint.join(tasks.filter("x <> y").select("g", "joint", F.col("y").alias("block")), ["joint", "block"])
    return one.unionByName(other).select("g", F.lit(2).alias("side"), "id", "c")


def classes_of(parts: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(members (class, id, rep, within), classes (class, rep, c, n, set, hot_prefix, members)) of parts that agree in n and hot.

    c is null where members are of several components; within tells whether what members share makes them partners.
    """
    members = parts.filter("size(hot) > 0").select(F.xxhash64("n", "hot").alias("class"), "id", "c", "n", "hot", "hot_prefix")
    classes = members.groupBy("class").agg(
        F.min("id").alias("rep"),
        F.when((F.min("c") == F.max("c")) & (F.count("c") == F.count("*")), F.min("c")).alias("c"),
        F.first("n").alias("n"),
        F.first("hot").alias("set"),
        F.first("hot_prefix").alias("hot_prefix"),
        F.count("*").alias("members"),
    )
    classes = materialise(classes, "hot-classes")
    within = (F.col("members") > 1) & (F.size("set") >= need(F.col("n"), F.col("n"), percent))
    return members.select("class", "id").join(classes.select("class", "rep", within.alias("within")), "class"), classes


def unwound(levels: list[tuple[DataFrame, DataFrame]], links: DataFrame | None) -> DataFrame:
    """Links (a, b) of the first level's items, from (links of its own, members of its classes) of each level and the last one's links."""
    for own, members in reversed(levels):
        up = members.filter("within").select(F.col("rep").alias("a"), F.col("id").alias("b"))
        if links is not None:
            touched = materialise(links.select(F.col("a").alias("class")).union(links.select(F.col("b").alias("class"))).distinct(), "touched")
            up = members.join(bounded(touched), "class", "left_semi").select(F.col("rep").alias("a"), F.col("id").alias("b")).unionByName(up)
            reps = members.select("class", "rep").distinct()
            met = links.join(reps.select(F.col("class").alias("a"), F.col("rep").alias("rep_a")), "a").join(reps.select(F.col("class").alias("b"), F.col("rep").alias("rep_b")), "b")
            up = up.unionByName(met.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
        links = materialise(own.unionByName(up).filter("a <> b"), "level-links")
    return links


def _hot_links(items: DataFrame, percent: int, frequent: int, most: int) -> DataFrame:
    """Links (a, b) that put together all partners across components among items (id, c, n, set), a stored table.

    Each level gives links of its own items and the classes that are the items of the next; the
    levels are then unwound: a class with a link, or whose shared part makes its members partners,
    is linked with each of its members.
    """
    levels: list[tuple[DataFrame, DataFrame]] = []
    while True:
        parts = _hot_parts(items, percent, frequent, most)
        pairs = _rare_pairs(parts, percent)
        links = materialise(_compare(materialise(_probe_groups(pairs), "hot-groups"), items.select("id", "n", "set"), percent), "hot-links")
        members, classes = classes_of(parts, percent)
        levels.append((links, members))
        items = classes.select(F.col("class").alias("id"), "c", "n", "set", "hot_prefix")
        n, stood_for = (classes.agg(F.count("*"), F.coalesce(F.sum("members"), F.lit(0))).first())
        if n <= 1 or n > FEWER * stood_for or n == stood_for:
            break
    links = materialise(_compare(materialise(_block_groups(items, percent), "block-groups"), items.select("id", "n", "set"), percent), "hot-links") if n > 1 else None
    return unwound(levels, links)


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT, frequent: int = FREQUENT, most_frequent: int = MOST_FREQUENT
) -> DataFrame:
    """Columns: id, n_shingles, component_id (the least id reachable by links, itself included)."""
    texts, numbers = _texts(docs, id_col, text_col), None
    id_type = texts.schema["id"].dataType
    if isinstance(id_type, IntegralType):
        texts = texts.withColumn("id", F.col("id").cast("long"))
    else:  # numbered in their order
        numbers = texts.select("id").filter("id is not null").distinct().orderBy("id").select("id", F.monotonically_increasing_id().alias("number"))
        numbers = materialise(numbers, "id-numbers")
        texts = texts.join(numbers, "id", "left").select(F.col("number").alias("id"), "text")
    spark = docs.sparkSession
    with arrow_rows(spark, ARROW_ROWS), tidied(spark, "id-numbers", "prefixes", "class-components"):  # all jobs with Python run before this returns
        found = _components_of(texts, k, percent, frequent, most_frequent)
    if numbers is None:
        return found.select(F.col("id").cast(id_type).alias(id_col), "n_shingles", F.col("component").cast(id_type).alias("component_id"))
    named = found.join(numbers.select(F.col("number").alias("id"), F.col("id").alias("named")), "id", "left")
    named = named.join(numbers.select(F.col("number").alias("component"), F.col("id").alias("component_id")), "component", "left")
    return named.select(F.col("named").alias(id_col), "n_shingles", "component_id")


def _hot_tokens(named: DataFrame, rows: int) -> DataFrame | None:
    """(token) of the prefix shingles that over `rows` rows of named (prefix) hold, as far as an Arrow batch shows them; None if there are none."""

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, count = np.unique(np.concatenate(_arrays(batch.column(0)) or [np.zeros(0, np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token[count >= IN_A_BATCH])], ["token"])

    seen = materialise(named.select("prefix").mapInArrow(often, "token long").distinct(), "seen-tokens")
    counts = named.select(F.explode("prefix").alias("token")).join(bounded(seen), "token").groupBy("token").agg(F.count("*").alias("n"))
    hot = materialise(counts.filter(F.col("n") > rows).select("token"), "hot-tokens")
    return None if hot.isEmpty() else hot


def _grouped(posts: DataFrame, hot: DataFrame | None) -> DataFrame:
    """posts (token, id, n, early, …) of tokens with several rows, with lead, the least (id, n) of the token, and has_early.

    Groups are windows; those of hot tokens, which would be a task each, are aggregated and joined back.
    """
    group = Window.partitionBy("token")
    rest = posts if hot is None else posts.join(bounded(hot), "token", "left_anti")
    rest = rest.withColumn("members", F.count("*").over(group)).withColumn("lead", F.min(F.struct("id", "n")).over(group)).filter("members > 1").drop("members")
    rest = rest.withColumn("has_early", F.max("early").over(group))
    if hot is None:
        return rest
    large = posts.join(bounded(hot), "token", "left_semi")
    leads = large.groupBy("token").agg(F.min(F.struct("id", "n")).alias("lead"), F.max("early").alias("has_early"), F.count("*").alias("members")).filter("members > 1")
    return rest.unionByName(large.join(bounded(materialise(leads, "hot-leads")), "token").select(rest.columns))


def _components_of(texts: DataFrame, k: int, percent: int, frequent: int, most_frequent: int) -> DataFrame:
    spark = texts.sparkSession
    common = spark.sparkContext.broadcast(frequent_shingles(texts, k, frequent, most_frequent))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = common.value
        for batch in batches:
            for a, b, data, starts in chunks(batch, 1):
                sets = Words(data, starts).shingles(k)
                sums = [digests(s) for s in sets]
                firsts = [prefix_of(s, tokens, counts, percent) for s in sets]
                numbers = [[len(s) for s in sets], [d for d, _ in sums], [d for _, d in sums], [f for _, f in firsts]]
                columns = [batch.column(0).slice(a, b - a), *(pa.array(x, pa.int64()) for x in numbers), lists([p for p, _ in firsts])]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "d1", "d2", "last_f", "prefix"])

    own = materialise(texts.select("id", "text").mapInArrow(prefixes, "id long, n long, d1 long, d2 long, last_f long, prefix array<long>"), "prefixes")
    named = own.filter("id is not null and n > 0")
    classes = materialise(named.groupBy("n", "d1", "d2").agg(F.min("id").alias("node")), "classes")
    nodes = bounded(classes.select(F.col("node").alias("id")).distinct())
    posts = named.join(nodes, "id", "left_semi").select("id", "n", "last_f", F.element_at("prefix", -1).alias("last_t"), F.posexplode("prefix").alias("at", "token"))
    posts = posts.withColumn("early", F.col("n") - F.col("at") >= need(F.col("n"), F.col("n"), percent))
    posts = _grouped(posts, _hot_tokens(named, HOT_ROWS))
    posts = materialise(posts.select("token", "id", "n", "at", "early", "has_early", "last_f", "last_t", F.col("lead.id").alias("lead_id"), F.col("lead.n").alias("lead_n")), "shared-prefixes")
    shared = posts.groupBy("id").agg(F.max("n").alias("n"), F.max("last_f").alias("last_f"), F.max("last_t").alias("last_t"), F.collect_set("token").alias("tokens"), (F.countDistinct("n", "last_f", "last_t") > 1).alias("mixed"))
    shared = materialise(shared, "shared-by-node")
    stars = materialise(_likely(star_pairs(posts, percent), shared, percent), "stars")
    links = materialise(_compare_texts(_cluster_groups(stars, 1, False), texts, k, percent), "star-links")
    again = _compare_texts(_cluster_groups(stars, 2, True), texts, k, percent)
    comps = components(links.unionByName(materialise(again, "star-links")))
    pairs, large = _residual(posts, comps, percent)
    rest = _compare_texts(_probe_groups(_likely(pairs, shared, percent)), texts, k, percent)
    large = materialise(large, "large-nodes")
    if not large.isEmpty():
        sets = _sets_of(texts, large.select("id"), k).join(bounded(large), "id").select("id", "c", "n", "set").filter("n > 0")
        rest = rest.unionByName(_hot_links(materialise(sets, "hot-sets"), percent, frequent, most_frequent))
    rest = materialise(rest, "rest-links")
    if not rest.isEmpty():
        up = comps.withColumnRenamed("component", "up")
        by_a = rest.join(up, rest["a"] == up["id"], "left").select(F.coalesce("up", "a").alias("a"), "b")
        over = by_a.join(up, by_a["b"] == up["id"], "left").select("a", F.coalesce("up", "b").alias("b")).filter("a <> b")
        above = components(over).select(F.col("id").alias("component"), F.col("component").alias("top"))
        ids = comps.select("id", "component").unionByName(above.select(F.col("component").alias("id"), "component").join(comps.select("id"), "id", "left_anti"))
        comps = ids.join(above, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    found = classes.join(comps, classes["node"] == comps["id"], "left").select("n", "d1", "d2", F.coalesce("component", "node").alias("component"))
    found = bounded(materialise(found, "class-components"))
    out = own.select("id", "n", "d1", "d2").join(found, ["n", "d1", "d2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component"))

"""Near-duplicate documents by a chosen-path set similarity join, and their components.

Sets of word shingles become 64 minwise tokens. Every tree branches all distinct sets along a path
of its own tokens; nodes of one set end there, small nodes are compared exhaustively (on sketches,
then on full sets), and large nodes first tie what they can to a leader and then compare what is not
of the first leader's component with all members. No node is branched again, so a pair that meets in
a node of any size is lost to its sketches only. The trees are independent: a pair at the threshold t
meets in none of them with a probability of (1 - t ** tokens) ** trees. There are as many trees as
make that one in a million, and sketches turn down at most one more (``miss_bound`` has the sum).

What bounds memory and skew: equal sets are one class from the start; nodes are counted, never
gathered, until they are known to be small; large nodes send a member to its leader only, so a
dense group costs one comparison a member; what is left of a node then goes through blocks, which
costs the square of its size where its members are all apart. A block holds a bounded number of
shingles, whatever the lengths of its documents, and no stage gathers more than ``node_size``
documents or two blocks at once. Links stay in tables.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.common import id_type, mix64, shingle_sets, slices, staged, unstage, utf8

TOKENS = 64
LEADERS = 8  # of a large node
_ODD = (np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, TOKENS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, TOKENS, dtype=np.uint64)
_SALT = np.uint64(0xD6E8FEB86659FD93)


def sketch(texts: list[bytes], words: int) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Set sizes, 16-byte hashes of the sets, and minwise tokens (text x 64, uint32)."""
    sets = shingle_sets(texts, words)
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens = np.zeros((len(texts), TOKENS), np.uint32)
    keys = [b"\0" * 16] * len(texts)
    full = np.flatnonzero(sizes)
    if len(full):
        every = np.concatenate([sets[i] for i in full])
        at = np.cumsum(sizes[full]) - sizes[full]
        both = np.stack([np.add.reduceat(mix64(every), at), np.add.reduceat(mix64(every ^ _SALT), at)], axis=1)
        for i, k in zip(full, both.astype(">u8"), strict=True):
            keys[i] = k.tobytes()
        for t in range(TOKENS):
            value = (every * _ODD[t] + _ADD[t]) >> np.uint64(32)
            tokens[full, t] = np.minimum.reduceat(value, at)
    return sizes, keys, tokens


def signatures(docs: DataFrame, words: int, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, cid, k1, tokens): the set size, the class of equal sets, a text hash and the tokens of each row."""
    kind = id_type(docs, id_col)
    rows = docs.select(F.col(id_col).cast(kind).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("k1"), F.col(text).alias("text"))
    schema = f"doc_id {kind.simpleString()}, n_shingles long, cid binary, k1 long, tokens binary"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 1 << 20):
                sizes, keys, tokens = sketch([t.lower() for t in utf8(part.column(2).to_pylist())], words)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes), pa.array(keys, pa.binary()), part.column(1), pa.array([t.tobytes() for t in tokens], pa.binary())],
                    names=["doc_id", "n_shingles", "cid", "k1", "tokens"],
                )

    return rows.mapInArrow(run, schema)


class Forest:
    """Union-find over 0 to n - 1; the root of a group is its smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def least_matches(percent: int) -> int:
    """Equal tokens of 64 that a pair at the threshold has with a probability of 1 - 1e-6 or more."""
    least = 0
    while least < TOKENS and fewer_matches(percent, least + 1) <= 1e-6:
        least += 1
    return max(1, least)


def fewer_matches(percent: int, least: int) -> float:
    """Probability that a pair at the threshold has fewer than ``least`` equal tokens of 64."""
    p = percent / 100
    return sum(math.comb(TOKENS, k) * p**k * (1 - p) ** (TOKENS - k) for k in range(least))


def miss_bound(percent: int) -> float:
    """Bound of the probability that a pair at the threshold is missed: it meets in no tree, or sketches turn it down."""
    trees, path = plan_trees(percent)
    return (1 - (percent / 100) ** path) ** trees + fewer_matches(percent, least_matches(percent))


def candidate_groups(members: list[dict], percent: int) -> list[list[bytes]]:
    """Groups of a node's members that sketches can't tell apart: connected by sizes and tokens that fit the threshold."""
    n = len(members)
    size = np.array([m["n"] for m in members])
    marks = np.frombuffer(b"".join(m["marks"] for m in members), np.uint8).reshape(n, TOKENS)
    forest, least = Forest(n), least_matches(percent)
    for i in range(n - 1):
        fit = (marks[i + 1 :] == marks[i]).sum(axis=1) >= least
        rest = size[i + 1 :]
        fit &= 100 * np.minimum(rest, size[i]) >= percent * np.maximum(rest, size[i])
        for j in np.flatnonzero(fit).tolist():
            forest.join(i, i + 1 + j)
    groups: dict[int, list[bytes]] = {}
    for i, m in enumerate(members):
        groups.setdefault(forest.root(i), []).append(m["cid"])
    return [sorted(g) for g in groups.values() if len(g) > 1]


def spanning_links(sets: list[np.ndarray], percent: int, asked: np.ndarray | None = None, known: list[list[int]] = ()) -> list[tuple[int, int]]:
    """Links that span the components of ``sets`` (each of distinct items) at the threshold.

    Each set that is ``asked`` (default: all) is held against all sets at once: its items are marked
    and every set counts its marks. ``known`` are groups that are connected already.
    """
    forest, links = Forest(len(sets)), []
    for group in known:
        for i in group[1:]:
            forest.join(group[0], i)
    sizes = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(sizes)
    if len(full) < 2:
        return links
    items = np.unique(np.concatenate([sets[i] for i in full]), return_inverse=True)[1]
    size = sizes[full]
    ends = np.cumsum(size)
    mark = np.zeros(int(items.max()) + 1, np.int32)
    for k, i in enumerate(full.tolist()):
        if asked is not None and not asked[i]:
            continue
        own = items[ends[k] - size[k] : ends[k]]
        mark[own] = 1
        both = np.add.reduceat(mark[items], ends - size)
        mark[own] = 0
        for j in full[100 * both >= percent * (size + size[k] - both)].tolist():
            if forest.join(i, j):
                links.append((min(i, j), max(i, j)))
    return links


def _live(nodes: DataFrame) -> DataFrame:
    """``nodes`` (path, ...) that two or more sets share, with the node's size."""
    count = nodes.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return nodes.join(count, "path")


def plan_trees(percent: int, miss: float = 1e-6) -> tuple[int, int]:
    """How many trees there are and how many tokens the first branch of each takes: the longest that 64 tokens allow."""
    for path in (3, 2, 1):
        trees = max(1, math.ceil(math.log(miss) / math.log(1 - min(percent / 100, 0.999) ** path)))
        if trees * path <= TOKENS or path == 1:
            return min(trees, TOKENS // path), path
    raise AssertionError


def similar_links(docs: DataFrame, sig: DataFrame, words: int, percent: int, node_size: int = 256, block: int = 400_000, text: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets (cid, doc_id, n_docs), and links (a, b) between classes that span all components."""
    classes = staged(
        sig.where("n_shingles > 0").groupBy("cid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1")).alias("rep"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("n_docs"), F.max("tokens").alias("tokens")),
        "classes",
    )
    least = least_matches(percent)

    def low_bytes(batches):
        import pyarrow as pa

        for b in batches:
            t = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint32).reshape(-1, TOKENS).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in t], pa.binary())], names=["cid", "n", "marks"])

    marks = staged(classes.select("cid", "n", "tokens").mapInArrow(low_bytes, "cid binary, n long, marks binary"), "marks")
    take = lambda i: F.substring(F.col("tokens"), 4 * i + 1, 4)
    trees, path = plan_trees(percent)
    first = F.array(*[F.xxhash64(F.lit(t), *[take(path * t + i) for i in range(path)]) for t in range(trees)])
    nodes = classes.select(F.explode(first).alias("path"), "cid")
    nodes = staged(_live(nodes), "nodes")
    # no set outside these nodes is ever compared, so texts are fetched once
    texts = staged(_texts(docs, classes, nodes.select("cid"), text, id_col), "texts")
    small = nodes.where(F.col("size") <= node_size).join(marks, "cid").groupBy("path").agg(F.collect_list(F.struct("cid", "n", "marks")).alias("members"))
    large, stars, blocks, more = nodes.where(F.col("size") > node_size), None, None, []
    if not large.isEmpty():
        # tie the members of large nodes to the most similar of a few leaders each, on full sets
        tagged = large.join(marks, "cid")
        heads = tagged.groupBy("path", F.pmod(F.xxhash64("cid"), F.lit(LEADERS)).alias("slot")).agg(F.min(F.struct("cid", "n", "marks")).alias("head"))
        heads = heads.groupBy("path").agg(F.sort_array(F.collect_list("head")).alias("heads"))  # at most LEADERS of them
        tagged = tagged.join(heads, "path").select("path", "cid", "n", "marks", "heads")

        def near(batches):
            import pyarrow as pa

            for b in batches:
                rows = b.to_pydict()
                best, first = [], []
                for cid, n, own, many in zip(rows["cid"], rows["n"], rows["marks"], rows["heads"], strict=True):
                    own, top, lead = np.frombuffer(own, np.uint8), least - 1, None
                    for h in many:
                        equal = int((np.frombuffer(h["marks"], np.uint8) == own).sum())
                        if equal > top and h["cid"] != cid and 100 * min(n, h["n"]) >= percent * max(n, h["n"]):
                            top, lead = equal, h["cid"]
                    best.append(lead)
                    first.append(many[0]["cid"])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(best, pa.binary()), pa.array(first, pa.binary())], names=["path", "cid", "n", "lead", "first"])

        tagged = staged(tagged.mapInArrow(near, "path long, cid binary, n long, lead binary, first binary"), "leaders")
        pairs = tagged.where("lead is not null").select("lead", "cid").distinct()
        found = staged(_confirm_stars(pairs, texts, words, percent, node_size), "stars")
        stars = found.select(F.col("lead").alias("a"), F.col("cid").alias("b"))
        # pairs within one component have nothing to add: members apart from their node's first leader are open
        roots = staged(labels(stars), "roots")
        more = [tagged, found, roots]
        open_ = tagged.select("path", "cid", "n", "first").join(roots.select(F.col("node").alias("cid"), F.col("root").alias("own")), "cid", "left")
        open_ = open_.join(roots.select(F.col("node").alias("first"), F.col("root").alias("theirs")), "first", "left")
        own = F.coalesce("own", "cid")
        blocks = open_.select("path", "cid", "n", own.alias("root"), (own != F.coalesce("theirs", "first")).alias("q"))

    def split(batches):
        import pyarrow as pa

        for b in batches:
            found = [g for members in b.column(0).to_pylist() for g in candidate_groups(members, percent)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.binary()))], names=["members"])

    groups = staged(small.select("members").mapInArrow(split, "members array<binary>").distinct(), "groups")
    members = groups.select(F.xxhash64("members").alias("g"), F.explode("members").alias("cid")).distinct()
    links = members.join(texts, "cid").groupBy("g").applyInArrow(_within(words, percent), "a binary, b binary")
    if blocks is not None:
        links = links.unionByName(stars).unionByName(_confirm_blocks(staged(blocks, "blocks"), texts, words, percent, block))
    links = staged(links.distinct(), "links")
    unstage(marks, nodes, texts, groups, *more)
    return classes, links


def _texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame, text: str, id_col: str) -> DataFrame:
    """(cid, text) of one document of each wanted class."""
    reps = classes.join(wanted.distinct(), "cid", "left_semi").select("cid", F.col("rep.doc_id").alias("_id"), F.col("rep.k1").alias("_k1"))
    rows = docs.select(F.col(id_col).cast(id_type(docs, id_col)).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("_key", F.xxhash64("text"))
    both = rows.join(reps, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_k1") == F.col("_key")))
    return both.select("cid", "text").dropDuplicates(["cid"])


def _sets(texts, words: int) -> list[np.ndarray]:
    return shingle_sets([t.lower() for t in utf8(texts)], words)


def _within(words: int, percent: int):
    def run(table):
        import pyarrow as pa

        cids = table.column("cid").to_pylist()
        order = sorted(range(len(cids)), key=cids.__getitem__)
        texts = table.column("text").to_pylist()
        sets = _sets([texts[i] for i in order], words)
        links = spanning_links(sets, percent)
        return pa.table({"a": pa.array([cids[order[i]] for i, _ in links], pa.binary()), "b": pa.array([cids[order[j]] for _, j in links], pa.binary())})

    return run


def _confirm_stars(pairs: DataFrame, texts: DataFrame, words: int, percent: int, node_size: int) -> DataFrame:
    """Of pairs (lead, cid) those that are similar on full sets; a leader's members are dealt to chunks."""
    sizes = pairs.groupBy("lead").agg(F.count(F.lit(1)).alias("k"))
    parts = sizes.select("lead", F.ceil(F.col("k") / node_size).cast("long").alias("parts"))
    rows = pairs.join(parts, "lead").select("lead", "cid", F.pmod(F.xxhash64("cid"), "parts").alias("part"))
    heads = parts.select("lead", F.col("lead").alias("cid"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    whole = rows.unionByName(heads).join(texts, "cid")

    def run(table):
        import pyarrow as pa

        lead, cids = table.column("lead")[0].as_py(), table.column("cid").to_pylist()
        if lead not in cids:
            return pa.table({"lead": pa.array([], pa.binary()), "cid": pa.array([], pa.binary())})
        sets = _sets(table.column("text").to_pylist(), words)
        head, out = sets[cids.index(lead)], []
        for c, s in zip(cids, sets, strict=True):
            both = len(np.intersect1d(head, s, assume_unique=True))
            if c != lead and 100 * both >= percent * (len(head) + len(s) - both):
                out.append(c)
        return pa.table({"lead": pa.array([lead] * len(out), pa.binary()), "cid": pa.array(out, pa.binary())})

    return whole.groupBy("lead", "part").applyInArrow(run, "lead binary, cid binary")


def _confirm_blocks(blocks: DataFrame, texts: DataFrame, words: int, percent: int, block: int) -> DataFrame:
    """Large nodes: their open members as queries against all members, block by block, on full sets.

    Members of one component (root) need no comparison, so only links between roots are found.
    """
    weight = lambda n: F.ceil(F.col(n) / block).cast("long")
    count = blocks.groupBy("path").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("q"), F.col("n"))).alias("open")).where("open > 0")
    count = count.select("path", weight("all").alias("parts"), weight("open").alias("asks"))
    rows = blocks.join(count, "path").withColumn("part", F.pmod(F.xxhash64("cid"), "parts")).withColumn("ask", F.pmod(F.xxhash64(F.lit(3), "cid"), "asks"))
    # each member goes to its part, once for every block of queries; a query also to all other parts
    places = F.transform(F.sequence(F.lit(0).cast("long"), F.col("asks") - 1), lambda a: F.struct(F.col("part").alias("part"), a.alias("ask"), (F.col("q") & (a == F.col("ask"))).alias("q")))
    others = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda p: F.col("q") & (p != F.col("part"))), lambda p: F.struct(p.alias("part"), F.col("ask").alias("ask"), F.col("q").alias("q")))
    sides = rows.select("path", "cid", "root", F.explode(F.concat(places, others)).alias("at")).select("path", "cid", "root", "at.*")
    whole = sides.join(texts, "cid")

    def run(table):
        import pyarrow as pa

        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("cid", "q", "root", "text")), strict=True), key=lambda r: r[:2])
        cids, roots = [r[0] for r in rows], {}
        for i, r in enumerate(rows):
            roots.setdefault(r[2], []).append(i)
        links = spanning_links(_sets([r[3] for r in rows], words), percent, np.array([r[1] for r in rows]), list(roots.values())) if len(roots) > 1 else []
        return pa.table({"a": pa.array([cids[i] for i, _ in links], pa.binary()), "b": pa.array([cids[j] for _, j in links], pa.binary())})

    return whole.groupBy("path", "part", "ask").applyInArrow(run, "a binary, b binary")


def labels(links: DataFrame, rounds: int = 3) -> DataFrame:
    """(node, root): for every node of ``links`` (a, b) the smallest node that it reaches in ``rounds`` steps.

    Nodes of one root are connected; connected ones may still have different roots.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    out = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root"))
    for _ in range(rounds - 1):
        near = both.join(out, both["v"] == out["node"]).select("u", "root").unionByName(out.select(F.col("node").alias("u"), "root"))
        out = near.groupBy("u").agg(F.min("root").alias("root")).select(F.col("u").alias("node"), "root")
    return out


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the undirected ``links`` (a, b); the root is the smallest node reachable.

    Alternating large-star and small-star steps over aggregates and equi-joins; each round is a
    table in the shared folder. It ends once all edges lead from single ends to roots.
    """
    edges = staged(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        # done once every node is either the end of edges or has a single one
        ends = edges.select("u", F.lit(1).alias("out")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("out")))
        unsettled = ends.groupBy("u").agg(F.sum("out").alias("k"), F.min("out").alias("low")).where("k > 1 or k = 1 and low = 0")
        if unsettled.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        before, edges = edges, staged(small, "edges")
        unstage(before)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, node_size: int = 256, block: int = 400_000, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts have A-Z lower-cased; words are runs outside 0x20 and 0x09-0x0D; a set holds the distinct
    shingles of ``words`` words, or the whole sequence where there are fewer. Rows are linked if
    100 * intersection >= ``percent`` * union. ``component_id`` is the smallest doc_id reachable.

    Defined cases: null and empty texts and those without words have an empty set and stay alone;
    equal rows are linked like any copies; a null doc_id never is the smallest, and a row is kept
    where its doc_id is the component's; ids may be of any type that has an order; an empty table
    stays empty. Other columns are left out.
    """
    sig = staged(signatures(docs, words, text, id_col), "sig")
    classes, links = similar_links(docs, sig, words, percent, node_size, block, text=text, id_col=id_col)
    roots = components(links)
    own = classes.select("cid", F.col("rep.doc_id").alias("first"))
    tied = roots.join(own, roots["node"] == own["cid"]).select("cid", "root", "first")
    least = tied.groupBy("root").agg(F.min("first").alias("component_id"))
    tied = tied.join(least, "root").select("cid", "component_id")
    repeated = classes.where("n_docs > 1").select("cid", F.col("rep.doc_id").alias("first"))
    known = repeated.join(tied, "cid", "full_outer").select("cid", F.coalesce("component_id", "first").alias("component_id"))
    out = sig.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("cid")).alias("cid")).join(known, "cid", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

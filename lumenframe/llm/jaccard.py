"""Operator 3: exact Jaccard links between word-shingle sets, by adaptive multi-match prefixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, row_key, table
from .components import connected_components
from .windows import Words, count_levels, in_blocks, levels_of, mix, unpack

#: Posting lists up to this length give their pairs at once; longer ones are resolved through a leader first.
SHORT_LIST = 48
#: Sets of one long list that a task compares with as many others.
BLOCK = 4096
#: Cost of verifying a candidate, in postings read; prefixes are lengthened up to so many required matches.
VERIFY_COST, MOST_MATCHES = 20.0, 8
#: Bits of a set's sketch.
SKETCH = 1024

KEY = "row_key struct<a:bigint,b:bigint>"
SETS = f"doc_id bigint, {KEY}, n_shingles bigint, fp bigint, ell int, alone int, prefix_size int, index_size int, central double, sketch binary, shingles array<bigint>"


def _shingles(rows: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (shingle, text) pairs of a block, ascending."""
    words = Words([t.as_buffer().to_pybytes() for t in rows.column("text")], True)
    h, at = words.windows(k)
    text = words.text[at]
    few = np.flatnonzero((words.n_words > 0) & (words.n_words < k))
    if len(few):
        whole = np.array([_sequence(words.hashes[words.first[i] : words.first[i + 1]]) for i in few], np.uint64)
        h, text = np.concatenate([h, whole]), np.concatenate([text, few])
    order = np.lexsort((text, h))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], text[new]


def _sequence(hashes: np.ndarray) -> np.uint64:
    """One hash for a whole text of fewer words than a shingle."""
    out = np.array([len(hashes)], np.uint64)
    for x in hashes:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + x)
    return out[0]


def shingle_sets(docs: DataFrame, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its number of distinct shingles and, where it can have a link at all, its prefixes.

    Levels of document frequency come from count_levels over the highest hash bits; they order shingles rare
    first and need not be exact, only alike for all documents. A link needs percent of a set to be shared, so a
    document with too many shingles of frequency one has none: fp stays null. Others have fp (a hash of the
    set), shingles (those that are shared, rare first, after alone ones of frequency one), and two prefixes of them. Of
    two linked sets the first ell common shingles lie in the first prefix_size of the larger and the first
    index_size of the smaller, with the ell of either. For each ell the prefixes are one longer, and the number of
    documents with ell matches is at most the postings in the prefix over ell; the ell with the least estimated
    cost is taken. sketch: the parity of the number of shingles in each of SKETCH hash classes, so that two sketches
    differ in no more bits than their sets do in shingles. In a block, one document of each set carries the shingles.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("row_key"))
    blocks, scale = in_blocks(docs, carry=("row_key",))

    def distinct(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(_shingles(rows, k)[0] >> np.uint64(64 - scale.bits), return_counts=True)

    def sets(rows: pa.Table, reply: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.schema([("doc_id", pa.int64()), ("row_key", key), *own_schema]).empty_table()
        rows = unpack(rows.column("payload"))
        h, text = _shingles(rows, k)
        level = np.zeros(0, np.uint8)
        if len(h):
            level = levels_of(reply)[np.unique(h >> np.uint64(64 - scale.bits), return_inverse=True)[1]]
        order = np.lexsort((h, level, text))
        h, level, text = h[order], level[order], text[order]
        first = np.searchsorted(text, np.arange(rows.num_rows + 1))
        out, seen = [], set()
        for i in range(rows.num_rows):
            own, lev = h[first[i] : first[i + 1]], level[first[i] : first[i + 1]]
            n = len(own)
            need, index_need = -(-percent * n // 100), -(-2 * percent * n // (100 + percent))
            alone = int(np.searchsorted(lev, 1))
            if not n or n - alone < need:
                out.append((n, *[None] * 8))
                continue
            others = 2.0 ** ((lev[alone:].astype(float) + 7) / 8) - 1
            matches = np.arange(1, min(MOST_MATCHES, need) + 1)
            read = np.cumsum(others)[n - need + matches - alone - 1]
            ell = int(matches[np.argmin(read + VERIFY_COST * read / matches)])
            fp = int(mix(np.array([np.add.reduce(own) + np.uint64(n)], np.uint64)).view(np.int64)[0])
            sketch = shingles = None
            if fp not in seen:
                seen.add(fp)
                sketch = np.packbits(np.bincount((own & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).tobytes()
                shingles = own[alone:].view(np.int64)
            out.append((n, fp, ell, alone, n - need + ell - alone, n - index_need + ell - alone, float(lev.mean()), sketch, shingles))
        found = [pa.array(c, f.type) for c, f in zip(zip(*out), own_schema)]
        return pa.table([rows.column("doc_id"), rows.column("carry_row_key").cast(key), *found], names=["doc_id", "row_key", *(f.name for f in own_schema)])

    key = pa.struct([("a", pa.int64()), ("b", pa.int64())])
    own_schema = [pa.field(*f) for f in [("n_shingles", pa.int64()), ("fp", pa.int64()), ("ell", pa.int32()), ("alone", pa.int32()), ("prefix_size", pa.int32()), ("index_size", pa.int32()), ("central", pa.float64()), ("sketch", pa.binary()), ("shingles", pa.list_(pa.int64()))]]
    reply = count_levels(blocks, scale, distinct)
    return blocks.groupBy("block").cogroup(reply.groupBy("block")).applyInArrow(sets, SETS)


def _near(a, b, percent: int):
    """Sets of these sizes can be linked."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _linked(shared, a, b, percent: int):
    """Sets of these sizes with so many common shingles are linked."""
    return 100 * shared >= percent * (a + b - shared)


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are linked."""
    left = nodes.select(F.col("fp").alias("a"), F.col("n_shingles").alias("na"), F.col("shingles").alias("sa"))
    right = nodes.select(F.col("fp").alias("b"), F.col("n_shingles").alias("nb"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", shared.alias("shared"))
    return both.where(_linked(F.col("shared"), F.col("na"), F.col("nb"), percent)).select("a", "b")


def _ordered(x, y) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _may_link(u: pa.Table, v: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of pairs from two blocks of one posting list that have to be verified."""
    col = lambda t, name: t.column(name).to_numpy()
    bits = lambda t: np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(t.num_rows, -1)
    names = ("fp", "n_shingles", "place", "indexed", "component", "in_main")
    a, b, u_bits, v_bits = {c: col(u, c) for c in names}, {c: col(v, c) for c in names}, bits(u), bits(v)
    at, to = [], []
    step = max(1, (1 << 19) // max(1, v.num_rows))
    for s in range(0, u.num_rows, step):
        x = {c: y[s : s + step, None] for c, y in a.items()}
        sizes = x["n_shingles"] + b["n_shingles"]
        smaller = (x["n_shingles"] < b["n_shingles"]) | ((x["n_shingles"] == b["n_shingles"]) & (x["fp"] < b["fp"]))
        fine = (x["component"] != b["component"]) & (b["in_main"] | (x["fp"] < b["fp"])) & np.where(smaller, x["indexed"], b["indexed"])
        before, after = x["place"] - b["place"], x["n_shingles"] - b["n_shingles"]
        fine &= (100 + percent) * (np.abs(before) + np.abs(after - before)) <= (100 - percent) * sizes
        p, q = np.nonzero(fine)
        differ = np.zeros(len(p), np.int64)
        for w in range(u_bits.shape[1]):
            differ += np.bitwise_count(u_bits[s + p, w] ^ v_bits[q, w])
        fine = (100 + percent) * differ <= (100 - percent) * sizes[p, q]
        at.append(s + p[fine])
        to.append(q[fine])
    return np.concatenate(at), np.concatenate(to)


def _open_pairs(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components to verify, from lists of several components.

    rest: token, fp, n_shingles, place, indexed, component, in_main, sketch, and others and size: the sets of the list
    outside its main component, and all. Those are compared with all, block by block: a group of a block of each has
    2 * BLOCK rows on average, however long the list is.
    """
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    dealt = lambda n: F.pmod(F.xxhash64("fp", "token"), blocks(n)).cast("int")
    row = ["token", "fp", "n_shingles", "place", "indexed", "component", "in_main", "sketch"]
    u = rest.where("not in_main").select(*row, dealt("others").alias("i"), F.explode(F.sequence(F.lit(0), blocks("size") - 1)).alias("j"), F.lit(True).alias("first"))
    v = rest.select(*row, F.explode(F.sequence(F.lit(0), blocks("others") - 1)).alias("i"), dealt("size").alias("j"), F.lit(False).alias("first"))

    def compare(rows: pa.Table) -> pa.Table:
        first = rows.column("first").to_numpy()
        u, v = rows.take(pa.array(np.flatnonzero(first))), rows.take(pa.array(np.flatnonzero(~first)))
        if not u.num_rows or not v.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        p, q = _may_link(u, v, percent)
        x, y = u.column("fp").to_numpy()[p], v.column("fp").to_numpy()[q]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return u.union(v.select(u.columns)).groupBy("token", "i", "j").applyInArrow(compare, "a bigint, b bigint")


def set_components(nodes: DataFrame, percent: int) -> DataFrame:
    """node and component for the distinct sets that have a link; every link is found.

    Two sets match at a shingle of the larger one's prefix that is in the index prefix of the smaller; linked sets have
    as many matches as the smaller of their two required numbers. Posting lists without an index entry, such as
    those of a passage in documents of which each has much text of its own, have no match and are dropped.
    A list of SHORT_LIST sets or fewer gives its pairs; those with enough matches in such lists are verified. In a
    longer list all sets are compared with the set of the most frequent shingles on average, which in a group of
    edited copies is close to all others. What is then in another component than most of its list is compared with
    all sets of the list outside its own component, in blocks, by sizes, places and sketches (_open_pairs); pairs
    that may be linked by these are verified, whatever their number of matches, so that matches in short lists cannot
    be missed. Pairs of one component are left out as they change nothing, so that a group of n copies does not
    give n * n pairs.
    """
    prefix = F.slice("shingles", 1, F.col("prefix_size"))
    posts = nodes.select("fp", "n_shingles", "ell", "central", "alone", "index_size", F.posexplode(prefix).alias("i", "token"))
    posts = posts.select("token", "fp", "n_shingles", "ell", "central", (F.col("alone") + F.col("i")).alias("place"), (F.col("i") < F.col("index_size")).alias("indexed"))
    lead = F.max(F.struct("central", "fp", F.col("n_shingles").alias("n"))).alias("lead")
    lists = posts.groupBy("token").agg(F.count("*").alias("c"), F.max("indexed").alias("some"), lead).where("c > 1 and some")
    lists = materialize(lists.select("token", "c", F.col("lead.fp").alias("lead"), F.col("lead.n").alias("lead_n")), "lists")
    posts = materialize(posts.drop("central").join(lists, "token"), "posts")

    members = posts.where(F.col("c") <= SHORT_LIST).groupBy("token").agg(F.sort_array(F.collect_list(F.struct("n_shingles", "fp", "ell", "place", "indexed"))).alias("m"))

    def pair(x, y):  # x comes first by size and fp
        before, after = x["place"] - y["place"], x["n_shingles"] - y["n_shingles"]
        near = (100 + percent) * (F.abs(before) + F.abs(after - before)) <= (100 - percent) * (x["n_shingles"] + y["n_shingles"])
        return F.struct(*_ordered(x["fp"], y["fp"]), F.least(x["ell"], y["ell"]).alias("need"), (near & x["indexed"]).alias("near"))

    pairs = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice(F.col("m"), i + 2, F.size("m")), lambda y: pair(x, y))))
    pairs = members.select(F.explode(F.filter(pairs, lambda p: p["near"])).alias("p")).select("p.a", "p.b", "p.need")
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("k"), F.first("need").alias("need")).where("k >= need").select("a", "b")

    long = posts.where(F.col("c") > SHORT_LIST)
    led = long.where((F.col("fp") != F.col("lead")) & _near(F.col("n_shingles"), F.col("lead_n"), percent)).select(*_ordered(F.col("fp"), F.col("lead")))
    found = connected_components(_verified(materialize(pairs.union(led).distinct(), "pairs"), nodes, percent))
    if long.isEmpty():
        return found

    found = materialize(found, "components")
    long = long.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("token", "fp", "n_shingles", "place", "indexed", F.coalesce("component", "fp").alias("component"))
    long = materialize(long, "long")
    sizes = long.groupBy("token", "component").agg(F.count("*").alias("n"))
    mains = sizes.groupBy("token").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("size")).where("main.n < size")
    mains = materialize(mains.select("token", F.col("main.component").alias("main"), "size", (F.col("size") - F.col("main.n")).alias("others")), "mains")
    rest = materialize(long.join(mains, "token"), "open")
    rest = rest.withColumn("in_main", F.col("component") == F.col("main")).join(nodes.select("fp", "sketch"), "fp")
    more = materialize(_open_pairs(rest, percent).distinct(), "more")
    more = materialize(_verified(more, nodes, percent), "new-links")
    return found if more.isEmpty() else connected_components(more.union(found.select("node", "component")))


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, row_key and kept for every document.

    Words are the runs of bytes other than space and \\t \\n \\v \\f \\r, with A-Z in lower case. A set holds the
    distinct shingles of k words, or with fewer words the whole sequence as one; null, empty and blank texts
    have the empty set and no link. Two documents link when 100 * intersection >= percent * union. component_id is
    the smallest id reachable by links. Rows of one id are compared as separate documents; rows with a null id take
    part, and have a null component_id where no linked document has an id. row_key (see common.row_key) tells rows of
    another id or text apart. kept is true for rows of one row_key in each component, the least by id with nulls last
    (so equal rows are kept together), and for all rows without shingles. Sets are compared by 64-bit hashes of
    shingles.
    """
    sets = materialize(shingle_sets(docs, k=k, percent=percent, id_col=id_col, text_col=text_col), "sets")
    nodes = sets.where("shingles is not null").drop("doc_id", "row_key").dropDuplicates(["fp"])
    nodes = materialize(nodes, "nodes")
    found = set_components(nodes, percent)
    grouped = sets.where("fp is not null").select("doc_id", "row_key", "n_shingles", "fp").join(found.withColumnRenamed("node", "fp"), "fp", "left")
    grouped = materialize(grouped.select("doc_id", "row_key", "n_shingles", F.coalesce("component", "fp").alias("group")), "grouped")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("least")
    first = materialize(grouped.groupBy("group").agg(least), "first")
    linked = grouped.join(first, "group").select("doc_id", "n_shingles", F.col("least.doc_id").alias("component_id"), "row_key", (F.col("row_key") == F.col("least.row_key")).alias("kept"))
    return linked.union(sets.where("fp is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "row_key", F.lit(True).alias("kept")))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents: five-word shingles, a similarity of 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")

"""N-gram Jaccard join with several global token orders.

Two sets whose similarity reaches the threshold share a token among the first of both, under any
order of all tokens. Under the first order the sets' prefixes meet in a join on the token. How deep
in both sets a shared token may lie, and how many must be shared down to that depth, follows from the
sizes of the pair; this drops nearly all pairs that only have a passage in common. Pairs whose parity
sketches differ in more bits than linked sets can differ in tokens are dropped in the same join.
What is left must also share prefix tokens under every further order, and is then compared exactly.

Tokens that a sample of documents holds often come last in every order, so passages that many
documents share do not meet. The sample (`SAMPLE_SHARE` of the documents, `FREQUENT` tokens at
most) only shapes the orders; any order gives the same result.

The result is the components of the links. Equal sets are one node. Before pairs are formed, rounds of
hubs join most of a large group of near copies: a token has one hub a round, by another hash each
time, and each node is compared with one hub of another component. A round is linear in the postings.
When rounds find little more, what still lies between components is found in full, so the inner pairs
of a group are never formed and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.components import connected
from tidemark.llm.frames import staged
from tidemark.llm.words import find_words, mix, shingles, slices

SAMPLE_SHARE = 0.1
OFTEN = 4
FREQUENT = 500_000
ORDERS = 3
DEEPER = 0.03
# longs of a parity sketch
SKETCH = 16
BROADCAST_IDS = 1_000_000
BROADCAST_GROUPS = 250_000
# rounds of hubs go on while one finds more than so many of the links of the first
ROUND_SHARE = 0.02
# longs that a task keeps of sets it may need again
KEPT_LONGS = 1 << 20
SKETCHED = [f"k{i}" for i in range(SKETCH)]
_TOP = np.uint64(1 << 63)
_SEEDS = mix(np.arange(1, 17, dtype=np.uint64))


def signature(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order."""
    if not len(tokens):
        return 0, 0
    total = mix(tokens + np.uint64(77)).sum(dtype=np.uint64)
    mixed = np.bitwise_xor.reduce(mix(tokens * np.uint64(0xD1342543DE82EF95)))
    return int(total.astype(np.int64)), int(mixed.astype(np.int64))


def parity_sketch(tokens: np.ndarray) -> np.ndarray:
    """Per bit, whether an odd number of the tokens hash to it.

    A token that only one of two sets holds turns one bit over, so two sketches never differ in more
    bits than the sets differ in tokens.
    """
    bits = (mix(tokens ^ _SEEDS[-1]) % np.uint64(64 * SKETCH)).astype(np.int64)
    return np.packbits(np.bincount(bits, minlength=64 * SKETCH).astype(np.uint8) & 1).view(np.int64)


def prefix_length(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def ordered(tokens: np.ndarray, frequent: np.ndarray, order: int) -> np.ndarray:
    """Places of tokens in a global order: frequent ones after all others, each part by hash."""
    places = mix(tokens ^ _SEEDS[order]) >> np.uint64(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        places = np.where(frequent[at] == tokens, places | _TOP, places)
    return places


def prefix(tokens: np.ndarray, frequent: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The first tokens of a set in an order, in that order."""
    p = prefix_length(len(tokens), percent)
    places = ordered(tokens, frequent, order)
    chosen = np.argpartition(places, p - 1)[:p] if p < len(tokens) else np.arange(len(tokens))
    return tokens[chosen[np.argsort(places[chosen])]]


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    words = find_words(batch.column("text"))
    for i in range(batch.num_rows):
        yield shingles(words.hash[words.first[i] : words.first[i + 1]], width)


def signatures(docs: DataFrame, width: int, with_text: bool = False) -> DataFrame:
    """(doc_id, n_shingles, s1, s2) and the parity sketch of each row, and its text where asked for."""
    names = ["n_shingles", "s1", "s2", *SKETCHED]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = np.array([(len(t), *signature(t), *parity_sketch(t)) for t in _sets(batch, width)], np.int64)
            columns = [pa.array(c) for c in rows.reshape(-1, len(names)).T]
            more = [batch.column("text")] if with_text else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, *more], names=["doc_id", *names, *["text"][: len(more)]])

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", *names)) + (", text string" if with_text else ""))


def frequent_tokens(docs: DataFrame, width: int, share: float) -> np.ndarray:
    """At most `FREQUENT` tokens, the most frequent in a sample of the documents by hash of id; sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            tokens, counts = np.unique(np.concatenate([*_sets(batch, width), np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(counts)], names=["token", "n"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000))
    counts = sample.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    rows = counts.orderBy(F.desc("n"), "token").limit(FREQUENT).select("token").toPandas()
    return np.sort(rows["token"].to_numpy(np.int64).view(np.uint64))


def postings(docs: DataFrame, frequent, width: int, percent: int) -> DataFrame:
    """(token, node, n, pos) of the first order's prefixes: the set's size and the token's rank in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = frequent.value
        for batch in slices(batches, "text"):
            sets = list(_sets(batch, width))
            parts = [prefix(t, common, 0, percent) if len(t) else t for t in sets]
            sizes = [len(x) for x in parts]
            token = np.concatenate(parts).view(np.int64)
            node = np.repeat(batch.column("doc_id").to_numpy(), sizes)
            n = np.repeat(np.array([len(t) for t in sets], np.int64), sizes)
            pos = np.concatenate([np.arange(k) for k in sizes])
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(node), pa.array(n), pa.array(pos)], names=["token", "node", "n", "pos"])

    return docs.mapInArrow(run, "token long, node long, n long, pos long")


def shared_only(rows: DataFrame) -> DataFrame:
    """The postings whose token another posting has too, with the token's hub, the first of its nodes by hash.

    One shuffle; tokens are compared in sorted order, and only a row or two wait for the next batch.
    """
    names = ["hub", "hub_n", "hub_pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, token_before, hub_before = None, None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            columns = [batch.column(c).to_numpy() for c in ("token", "node", "n", "pos")]
            if held is not None:
                columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
            token = columns[0]
            begins = np.concatenate([[True], token[1:] != token[:-1]])
            at = np.maximum.accumulate(np.where(begins, np.arange(len(token)), 0))
            hubs = [c[at] for c in columns[1:]]
            more = token == token_before if token_before is not None else np.zeros(len(token), bool)
            for c, value in zip(hubs, hub_before or (), strict=False):
                c[more] = value
            alike = np.concatenate([~begins, [False]])
            keep = alike[:-1] | alike[1:] | more
            # the last row cannot know its neighbour yet
            done = len(token) - 1
            token_before, hub_before = (token[done], [h[done] for h in hubs]) if keep[done] else (None, None)
            if keep[done]:
                done += 1
            yield _batch([c[:done][keep[:done]] for c in (*columns, *hubs)])
            held = [c[done:] for c in columns]
            held = held if len(held[0]) else None

    def _batch(columns: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "node", "n", "pos", *names])

    sorted_rows = rows.repartition("token").withColumn("_mark", F.xxhash64("node")).sortWithinPartitions("token", "_mark", "node").drop("_mark")
    return sorted_rows.mapInArrow(run, "token long, node long, n long, pos long, hub long, hub_n long, hub_pos long")


def _needed(n_a: Column, n_b: Column, percent: int) -> Column:
    """Tokens that linked sets of these sizes share at least."""
    return F.ceil(percent * (n_a + n_b) / (100 + percent))


def _deeper(n_a: Column, n_b: Column, percent: int) -> Column:
    """How much further than for one shared token the prefixes of a pair are looked at."""
    spare = lambda n: _needed(n_a, n_b, percent) - F.floor((percent * n + 99) / 100)
    return F.greatest(F.least(F.floor(DEEPER * F.least(n_a, n_b)), spare(n_a), spare(n_b)), F.lit(0))


def deep_enough(n_a: Column, pos_a: Column, n_b: Column, pos_b: Column, percent: int) -> Column:
    """Whether a shared token counts: the sizes can link and it lies in the prefixes that matter for the pair."""
    needed, deeper = _needed(n_a, n_b, percent), _deeper(n_a, n_b, percent)
    sizes = 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)
    return sizes & (pos_a <= n_a - needed + deeper) & (pos_b <= n_b - needed + deeper)


def can_link(c: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    """Whether `c` shared tokens of those prefixes leave enough: of the set whose prefix ends first in the
    order, all but needed - 1 - deeper tokens were seen, so linked sets share more than `deeper` of them."""
    return c > _deeper(n_a, n_b, percent)


def near_enough(n_a: Column, n_b: Column, bits: list[tuple[Column, Column]], percent: int) -> Column:
    """Whether the sketches allow a link; true where one is missing."""
    return F.coalesce(bits_apart(bits) <= n_a + n_b - 2 * _needed(n_a, n_b, percent), F.lit(True))


def bits_apart(bits: list[tuple[Column, Column]]) -> Column:
    """Bits in which two sketches differ."""
    return sum((F.bit_count(a.bitwiseXOR(b)) for a, b in bits[1:]), F.bit_count(bits[0][0].bitwiseXOR(bits[0][1])))


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the given ids: without a shuffle of texts where the ids are few."""
    ids = staged(ids.distinct(), "ids")
    return staged(docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id"), "texts")


def verified(pairs: DataFrame, docs: DataFrame, frequent, width: int, percent: int, orders: int) -> DataFrame:
    """Of pairs (a, b) those that pass every further order's prefix filter and then link exactly."""
    pairs = staged(pairs.select("a", "b").distinct(), "pairs")
    if pairs.isEmpty():
        return pairs
    texts = texts_of(docs, pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))))
    first = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text"))
    second = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, known, held = frequent.value, {}, 0

        def prefixes(tokens: np.ndarray) -> tuple:
            return tokens, [np.sort(prefix(tokens, common, k, percent)) for k in range(1, orders)]

        for batch in slices(batches, "text"):
            keep = []
            others = batch.column("text_b").to_pylist()
            for tokens, b, other in zip(_sets(batch, width), batch.column("b").to_pylist(), others, strict=True):
                if b not in known:
                    if held > KEPT_LONGS:
                        known, held = {}, 0
                    known[b] = prefixes(next(_sets(pa.RecordBatch.from_arrays([pa.array([other])], names=["text"]), width)))
                    held += 2 * len(known[b][0])
                tokens_b, prefixes_b = known[b]
                tokens, prefixes_a = prefixes(tokens)
                pass_all = all(len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(prefixes_a, prefixes_b, strict=True))
                common_tokens = len(np.intersect1d(tokens, tokens_b, assume_unique=True)) if pass_all else 0
                keep.append(common_tokens > 0 and 100 * common_tokens >= percent * (len(tokens) + len(tokens_b) - common_tokens))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(first, "a").join(second, "b").select("a", "b", "text", "text_b")
    return staged(joined.mapInArrow(run, "a long, b long"), "links")


def _relabelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """`nodes` (node, component) after linking components (u, v)."""
    if links.isEmpty():
        return nodes
    roots = connected(links)
    joined = nodes.join(roots.select(F.col("node").alias("component"), "root"), "component", "left")
    return staged(joined.select("node", F.coalesce("root", "component").alias("component")), "components")


def _with_components(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """`rows` with the component of their node: only nodes that are not their own component are joined."""
    moved = staged(nodes.where(F.col("node") != F.col("component")), "moved")
    moved = F.broadcast(moved) if moved.count() <= BROADCAST_IDS else moved
    return rows.join(moved, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _between(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Component ends of linked nodes."""
    a = nodes.select(F.col("node").alias("a"), F.col("component").alias("u"))
    b = nodes.select(F.col("node").alias("b"), F.col("component").alias("v"))
    return pairs.join(a, "a").join(b, "b").select("u", "v")


def _copies_of(keys: list[str], named: DataFrame) -> DataFrame:
    """`named` with the node of its set, the smallest id that has it: only sets of several rows are joined."""
    groups = staged(named.groupBy(*keys).agg(F.min("doc_id").alias("node"), F.count("*").alias("n_rows")).where("n_rows > 1").drop("n_rows"), "copies")
    # a set that very many rows have must not be dealt to one task
    groups = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
    return named.join(groups, keys, "left").withColumn("node", F.coalesce("node", "doc_id"))


def _own_nodes(docs: DataFrame, named: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(texts by node, nodes of ids with several sets): each set of such an id gets a number of its own that is no id."""
    keys = ["n_shingles", "s1", "s2"]
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    many = named.groupBy("doc_id").agg(F.min(F.struct(*keys)).alias("low"), F.max(F.struct(*keys)).alias("high")).where("low <> high").select("doc_id")
    many = staged(many, "repeated-ids")
    n = many.count()
    if n == 0:
        return texts, named.select("doc_id", F.col("doc_id").alias("node")).limit(0)
    side = F.broadcast(many) if n <= BROADCAST_IDS else many
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    number = F.monotonically_increasing_id()
    number = number + F.lit(1 << 62) if high < 1 << 62 else number - F.lit((1 << 63) - 1) if low > -(1 << 62) else F.xxhash64("doc_id", *keys)
    sets = staged(named.join(side, "doc_id", "left_semi").select("doc_id", *keys).distinct(), "repeated-sets")
    sets = staged(sets.withColumn("node", number), "own-nodes")
    signed = signatures(texts.join(side, "doc_id", "left_semi"), width, with_text=True)
    own = signed.join(sets, ["doc_id", *keys]).groupBy("node").agg(F.min("text").alias("text"))
    return texts.join(side, "doc_id", "left_anti").unionByName(own.select(F.col("node").alias("doc_id"), "text")), sets.select("doc_id", "node", *keys)


def _hub_pairs(posted: DataFrame, sketches: DataFrame, round_: int, percent: int) -> DataFrame:
    """(node, hub): for each node the hub of another component that looks most alike, if one may link.

    Each token has one hub a round, the first of its nodes by a hash of token and round, so a node meets
    as many hubs as it has tokens and no token makes more rows than it has.
    """
    first = F.first(F.struct("node", "n", "component")).over(Window.partitionBy("token").orderBy(F.xxhash64("node", "token", F.lit(round_)), "node"))
    rows = posted.withColumn("hub", first).where((F.col("component") != F.col("hub.component")) & (100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")))
    pairs = rows.select("node", "n", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")).distinct()
    of = lambda name: sketches.select(F.col("node").alias(name), *(F.col(k).alias(f"{name}_{k}") for k in SKETCHED))
    met = pairs.join(of("node"), "node").join(of("hub"), "hub")
    bits = [(F.col(f"node_{k}"), F.col(f"hub_{k}")) for k in SKETCHED]
    likeness = F.struct((-bits_apart(bits) / (F.col("n") + F.col("hub_n"))).alias("near"), "hub")
    return met.where(near_enough(F.col("n"), F.col("hub_n"), bits, percent)).groupBy("node").agg(F.max_by("hub", likeness).alias("hub"))


def similar(docs: DataFrame, percent: int = 75, width: int = 5, orders: int = ORDERS, sample_share: float = SAMPLE_SHARE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of `docs` (doc_id, text).

    A set holds the distinct `width`-word shingles of the whole text, lower-cased A to Z; of fewer
    words, all of them as one. Sets link when their Jaccard similarity is at least `percent` percent.
    component_id is the smallest doc_id reachable. A null, empty or blank text has no set and is its
    own component. A row without id has component null and links nothing. Each set of an id that
    several rows repeat is a node of its own, and the id links them, so all rows of an id have one
    component, each with its own size. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = ["n_shingles", "s1", "s2"]
    signs = staged(signatures(docs, width), "signatures")
    named = signs.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    texts, own = _own_nodes(docs, named, width)
    # from here on a node is an id with one set, or a set of an id with several
    own = staged(own, "own")
    single = named.select("doc_id", *keys, *SKETCHED)
    if not own.isEmpty():
        sets = own.join(named, ["doc_id", *keys]).select(F.col("node").alias("doc_id"), *keys, *SKETCHED).dropDuplicates(["doc_id"])
        single = single.join(own.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(sets)
    node_of = staged(_copies_of(keys, single), "nodes-of")
    copies = node_of.where("doc_id <> node").select("doc_id").distinct()
    alone = texts.join(F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies, "doc_id", "left_anti")
    frequent = spark.sparkContext.broadcast(frequent_tokens(texts, width, sample_share))
    posted = staged(shared_only(postings(alone, frequent, width, percent)).select("token", "node", "n", "pos"), "postings")
    sketches = staged(node_of.where("doc_id = node").select("node", *SKETCHED).dropDuplicates(["node"]), "sketches")
    nodes = staged(sketches.select("node", F.col("node").alias("component")), "components")
    if not own.isEmpty():
        # the sets of an id are linked by the id
        ends = own.select(F.col("doc_id").alias("id"), F.col("node").alias("doc_id")).join(node_of.select("doc_id", "node"), "doc_id")
        nodes = _relabelled(nodes, ends.join(ends.groupBy("id").agg(F.min("node").alias("u")), "id").select("u", F.col("node").alias("v")).where("u <> v"))

    a_b = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    round_, found_first = 0, 0
    while True:
        labelled = _with_components(posted, nodes)
        if round_:
            # tokens that lie in one component only cannot link two
            mixed = labelled.groupBy("token").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low <> _high").select("token")
            labelled = staged(labelled.join(mixed, "token"), "mixed")
            posted = labelled.drop("component")
        pairs = _hub_pairs(labelled, sketches, round_, percent)
        links = verified(pairs.select(*a_b(F.col("node"), F.col("hub"))), texts, frequent, width, percent, orders)
        found = links.count()
        nodes = _relabelled(nodes, _between(links, nodes))
        found_first = found_first or found
        if found <= ROUND_SHARE * found_first:
            break
        round_ += 1

    labelled = staged(_with_components(posted, nodes).join(sketches, "node", "left"), "mixed")
    kept = ("node", "n", "pos", "component", *SKETCHED)
    x, y = (labelled.select("token", *(F.col(c).alias(f"{c}_{s}") for c in kept)) for s in "xy")
    met = x.join(y, "token").where(
        (F.col("node_x") < F.col("node_y"))
        & (F.col("component_x") != F.col("component_y"))
        & deep_enough(*map(F.col, ("n_x", "pos_x", "n_y", "pos_y")), percent)
        & near_enough(F.col("n_x"), F.col("n_y"), [(F.col(f"{k}_x"), F.col(f"{k}_y")) for k in SKETCHED], percent)
    )
    counted = met.groupBy("node_x", "node_y").agg(F.count("*").alias("c"), F.max("n_x").alias("n_x"), F.max("n_y").alias("n_y"))
    able = counted.where(can_link(F.col("c"), F.col("n_x"), F.col("n_y"), percent))
    links = verified(able.select(*a_b(F.col("node_x"), F.col("node_y"))), texts, frequent, width, percent, orders)
    nodes = _relabelled(nodes, _between(links, nodes))
    frequent.unpersist()

    ids = node_of.select("doc_id", "node").join(nodes, "node").select("doc_id", "component")
    if not own.isEmpty():
        # numbers of sets give way to their ids, and a component is named by the smallest of these
        ids = staged(ids.join(own.select(F.col("doc_id").alias("_id"), F.col("node").alias("doc_id")), "doc_id", "left").select(F.coalesce("_id", "doc_id").alias("doc_id"), "component"), "ids")
        ids = ids.join(ids.groupBy("component").agg(F.min("doc_id").alias("_first")), "component").select("doc_id", F.col("_first").alias("component"))
    final = ids.groupBy(F.col("doc_id").alias("_id")).agg(F.min("component").alias("_component"))
    return signs.join(final, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "n_shingles", F.coalesce("_component", "doc_id").alias("component_id"))

"""MinHash near-duplicates with tensored banding: links by Jaccard similarity of word shingles, and their components.

A table's key joins one element of each of two collections of SIDE minhash groups, so that SIDE**2 tables cost 2 * SIDE
groups of ROWS minhashes: the square root of what independent tables take (Dahlgaard, Knudsen and Thorup, 2017). At a
similarity of 0.75 a pair shares no key with a probability of 5 in 10,000. Every link is confirmed on the full shingle sets.

Documents with equal shingle sets form one class, found by a 128-bit digest of the set, and only classes meet in the tables.
A group that no other class has cannot make a shared key: only groups that several classes have are combined into keys.
Pairs are never listed within a key; what is wanted are components, so:

1. in each of PIVOT_TURNS turns each class is compared with one pivot of its keys, and components are formed; a key whose
   classes are all in one component has nothing more to say. Keys are summed up by aggregation, never gathered;
2. the classes of keys that still hold several components are compared with hubs of their rarest shingles, until a turn
   links nothing: parts of one group are joined from no more rows than there are;
3. what is left goes through an exact join: prefixes of the rarest shingles, pairs of different components only, and of
   these only such as their places in the order of rarity and a sketch of 64 * LONGS bits allow: first the likeliest
   pairs, then all. With deviations=None sketches pass all pairs.

Cases: a null or empty text has no shingles and is linked with nothing; a text of fewer words than WORDS has its whole
sequence as one shingle; repeated rows are one class, each row is returned; rows with a null id take part, and get the
smallest id of their component; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graywacke.llm.common import Scratch, bounded, small_batches
from graywacke.llm.textvec import M, Texts, U, chunks, grams, mix

WORDS, SIMILAR = 5, 75
#: Minhash groups on a side, and minhashes in a group.
SIDE, ROWS = 10, 2
#: Turns in which each class is compared with one pivot before the exact join of what is left.
PIVOT_TURNS = 2
#: Turns at most in which what is left is compared with hubs of its rarest shingles; the first one that links nothing is the last.
HUB_TURNS = 2

#: Longs of bits in a sketch, and how many standard deviations beyond the mean the sketches of a pair may differ: at 4.2 one
#: pair in 70,000 of just the similarity asked is passed over, of more similar ones fewer.
LONGS, DEVIATIONS = 8, 4.2
SKETCH = [f"sketch_{k}" for k in range(LONGS)]
#: SQL of the number of bits in which the sketches of two rows differ.
BITS = " + ".join(f"bit_count({c} ^ {c}_2)" for c in SKETCH)

FACTORS, SKETCH_FACTORS = (np.random.Generator(np.random.PCG64(k)).integers(1, 1 << 63, n, dtype=np.uint64) * U(2) + U(1) for k, n in ((8, 2 * SIDE * ROWS), (88, 64 * LONGS)))


def shingles(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, repeats included, and the place of each text's first (one more at the end)."""
    batch = Texts(texts, lower=True)
    starts, ends, first = batch.words()
    hashes, n = batch.hashes(starts, ends), np.diff(first)
    many = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    at = np.append(0, np.cumsum(many))
    out = np.zeros(at[-1], U)
    long = n >= words
    if long.any():
        place = np.arange(at[-1]) - np.repeat(at[:-1], many) + np.repeat(first[:-1], many)
        mine = np.repeat(long, many)
        out[mine] = grams(hashes, words)[place[mine]]
    for i in np.flatnonzero((n > 0) & ~long):
        out[at[i]] = mix(grams(hashes[first[i] : first[i + 1]], int(n[i])) + U(n[i]))[0]
    return out, at


def sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The set of shingles of each text, sorted."""
    found, at = shingles(texts, words)
    return [np.unique(found[a:b]) for a, b in zip(at[:-1], at[1:])]


def signed(docs: DataFrame, words: int) -> DataFrame:
    """A row for each row of docs: doc_id, the text's hash, the size of its set, a digest of the set and 2 * SIDE group signatures."""

    @F.pandas_udf("n_shingles long, set_1 long, set_2 long, groups array<long>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done: list[pd.DataFrame] = []
            for run in chunks(batch):
                found, at = shingles(run, words)
                each = [np.unique(found[a:b]) for a, b in zip(at[:-1], at[1:])]
                full = np.flatnonzero(np.diff(at))
                groups = np.zeros((len(run), 2 * SIDE), U)
                if len(full):
                    least = [np.minimum.reduceat(found * f, at[full]) for f in FACTORS]
                    for g in range(2 * SIDE):
                        total = np.full(len(full), g + 1, U)
                        for k in range(ROWS):
                            total = mix(total * M + least[g * ROWS + k])
                        groups[full, g] = total
                names = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in each])
                done.append(pd.DataFrame({"n_shingles": [len(s) for s in each], "set_1": names[:, 0], "set_2": names[:, 1], "groups": list(groups.view(np.int64))}))
            yield pd.concat(done, ignore_index=True) if done else pd.DataFrame({"n_shingles": [], "set_1": [], "set_2": [], "groups": []}).astype({"n_shingles": int, "set_1": int, "set_2": int, "groups": object})

    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), sign("text").alias("s")).select("doc_id", "text_hash", "s.*")


def classed(base: DataFrame) -> DataFrame:
    """A row for each distinct set: a number for it, its smallest doc_id, the hash of a text, and its groups. To be saved: the numbers
    are those of one run."""
    rep = F.coalesce(F.min_by("text_hash", "doc_id"), F.min("text_hash"))
    rows = base.filter("n_shingles > 0").groupBy("set_1", "set_2").agg(F.min("doc_id").alias("doc"), rep.alias("rep_hash"), F.first("n_shingles").alias("n_shingles"), F.first("groups").alias("groups"))
    return rows.withColumn("node", F.monotonically_increasing_id())


def crowded(classes: DataFrame) -> DataFrame:
    """The classes that have groups in common with others on both sides: those groups (side_a, side_b), and how many others have them (degree)."""
    # The lowest bit of a group's name is its side.
    group = F.xxhash64("at", "g").bitwiseAND(-2).bitwiseOR(F.expr(f"cast(at div {SIDE} as long)"))
    groups = classes.select("node", F.posexplode("groups").alias("at", "g")).select("node", group.alias("group"))
    shared = groups.groupBy("group").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    side = lambda bit: F.collect_list(F.when(F.col("group").bitwiseAND(1) == bit, F.col("group")))
    mine = groups.join(shared, "group").groupBy("node").agg(side(0).alias("side_a"), side(1).alias("side_b"), F.sum("many").alias("degree"))
    return mine.filter("size(side_a) > 0 and size(side_b) > 0").join(classes.select("node", "doc", "rep_hash", "n_shingles"), "node")


def keyed(crowd: DataFrame) -> DataFrame:
    """A row for each class and table: the key joins a group of the first side with one of the second."""
    keys = F.expr("flatten(transform(side_a, a -> transform(side_b, b -> xxhash64(a, b))))")
    return crowd.select(F.explode(keys).alias("key"), "node")


def mixed(rows: DataFrame) -> DataFrame:
    """The rows (key, node, component) of the keys whose classes are of more than one component."""
    keys = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    return rows.join(keys, "key", "left_semi")


def pivots(met: DataFrame, crowd: DataFrame, turn: int, similar: int) -> DataFrame:
    """A pair (a, b) for each class at most, from met (key, node, component): with the pivot of one of its keys, of another component and a
    size that allows the similarity. A key's pivot is the class that has most groups in common with others (where copies vary, that is
    what they were made from), in later turns any."""
    rank = F.expr("degree * 1048576 + (xxhash64(node) & 1048575)") if turn == 0 else F.xxhash64("node", F.lit(turn))
    rows = met.join(crowd.select("node", "n_shingles", rank.alias("rank")), "node")
    first = rows.groupBy("key").agg(*(F.max_by(c, "rank").alias(f"first_{c}") for c in ("node", "component", "n_shingles")), F.max("rank").alias("first_rank"))
    fits = f"component <> first_component and 100 * least(n_shingles, first_n_shingles) >= {similar} * greatest(n_shingles, first_n_shingles)"
    best = rows.join(first, "key").filter(fits).groupBy("node").agg(F.max_by("first_node", "first_rank").alias("other"))
    return best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def full_sets(crowd: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the classes of crowd, from one text of each, read again from docs."""

    @F.pandas_udf("array<long>")
    def shingled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([s.view(np.int64) for run in chunks(batch) for s in sets(run, words)], dtype="object")

    small_batches(docs.sparkSession)
    named = docs.select(F.col("doc_id").alias("their_id"), "text", F.xxhash64("text").alias("their_hash"))
    texts = named.join(bounded(crowd.select("node", "doc", "rep_hash")), F.expr("their_id <=> doc and their_hash = rep_hash"))
    return texts.select("node", "text").dropDuplicates(["node"]).select("node", shingled("text").alias("shingles"))


def confirmed(pairs: DataFrame, full: DataFrame, similar: int) -> DataFrame:
    """Of pairs (a, b) of classes those whose shingle sets are as similar as asked, compared whole."""
    both = pairs.join(full.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a").join(full.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    rows = both.select("a", "b", common.alias("common"), (F.size("set_a") + F.size("set_b")).alias("total"))
    return rows.filter(f"100L * common >= {similar}L * (total - common)").select("a", "b")


class Components:
    """Which component each class of the links so far is in: (node, component), the smallest node naming a component.

    Each round takes the least label next door, then the label of the label, so that rounds grow with the logarithm of the
    longest chain. Links and labels stay distributed, in tables of the shared folder.
    """

    def __init__(self, scratch: Scratch, none: DataFrame):
        self.scratch, self.found, self.turn, self.named = scratch, none, 0, ""

    def add(self, links: DataFrame) -> None:
        """Joins what the links (a, b) join."""
        self.turn += 1
        name = f"links-{self.turn}"
        links = links.union(self.found.filter("node <> component").select("node", "component"))
        both = self.scratch.save(name, links.toDF("a", "b").union(links.toDF("a", "b").select("b", "a")).distinct())
        labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component"))
        k = 0
        while True:
            near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
            step = labels.join(near, labels.node == near.a, "left").select("node", "component", F.least("component", "near").alias("next"))
            up = step.select(F.col("node").alias("up"), F.col("next").alias("above"))
            above = F.coalesce("above", "next")
            moved = step.join(up, step.next == up.up, "left").select("node", above.alias("component"), (above != F.col("component")).alias("moved"))
            labels = self.scratch.save(f"{name}-{k}", moved)
            if k:
                self.scratch.drop(f"{name}-{k - 1}")
            done, labels, k = labels.filter("moved").isEmpty(), labels.select("node", "component"), k + 1
            if done:
                self.scratch.drop(name, *self.tables())
                self.found, self.named = labels, f"{name}-{k - 1}"
                return

    def tables(self) -> list[str]:
        """The names of the tables that it keeps."""
        return [self.named] if self.named else []

    def of(self, rows: DataFrame) -> DataFrame:
        """rows with their component: a class without links is one of its own."""
        return rows.join(self.found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def prefixes(nodes: DataFrame, similar: int) -> DataFrame:
    """(key, node, place) and the columns of nodes (node, n_shingles, shingles and sketch) but its sets, for the rarest shingles
    of each class; place: of the shingle among all of its class, by rarity. Two sets as similar as asked share one of their
    n - ceil(n * similar) + 1 rarest."""
    # What only one class has is first in its order and meets nobody: it counts, and goes no further.
    every = nodes.select("node", F.explode("shingles").alias("key"))
    shared = every.join(every.groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter("many > 1"), "key")
    mine = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("many", "key"))).alias("order"))
    ranked = mine.join(nodes.drop("shingles"), "node").withColumn("alone", F.col("n_shingles") - F.size("order"))
    wanted = ranked.withColumn("order", F.expr(f"slice(order, 1, greatest(0, cast(n_shingles - ceil(n_shingles * {similar} / 100) + 1 - alone as int)))"))
    return wanted.select("node", "n_shingles", *SKETCH, "alone", F.posexplode("order").alias("place", "o")).select("node", "n_shingles", *SKETCH, "o.key", (F.col("alone") + F.col("place") + 1).alias("place"))


def sketched(nodes: DataFrame) -> DataFrame:
    """nodes (shingles, ...) with a sketch: of two sets a bit of it is equal with a probability of (1 + similarity) / 2."""

    @F.pandas_udf(", ".join(f"{c} long" for c in SKETCH))
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(np.array([sketch_of(np.asarray(s, np.int64).view(U)) for s in batch], np.int64).reshape(-1, LONGS), columns=SKETCH)

    return nodes.withColumn("s", sketch("shingles")).select(*nodes.columns, "s.*")


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    """The lowest bit of each of 64 * LONGS minhashes."""
    least = np.full(64 * LONGS, ~U(0))
    for at in range(0, len(shingles), 256):
        least = np.minimum(least, (shingles[at : at + 256, None] * SKETCH_FACTORS).min(0))
    return np.packbits((mix(least) & U(1)).astype(np.uint8)).view(np.int64)


def allowed(similar: int, deviations: float | None) -> str:
    """Of two rows of prefixes (the columns of the second end in _2): whether they are of different components and may be as similar as asked.

    Of similar sets the first common shingle leaves enough of both behind it for what they must have in common; and their
    sketches differ in no more bits than that many standard deviations beyond the mean.
    """
    differ = (1 - similar / 100) / 2
    enough = f"1 + least(n_shingles - place, n_shingles_2 - place_2) >= ceil({similar} * (n_shingles + n_shingles_2) / {100 + similar})"
    close = "true"
    if deviations is not None:
        most = int(np.ceil(64 * LONGS * (differ + deviations * np.sqrt(differ * (1 - differ) / (64 * LONGS)))))
        close = f"{BITS} <= {most}"
    return f"component <> component_2 and {enough} and {close}"


def hubs(rows: DataFrame, similar: int, deviations: float | None, turn: int) -> DataFrame:
    """A pair (a, b) for each class at most, from rows (key, component and the columns of prefixes): of the hubs of its keys, a class picked
    for each, that with the nearest sketch, if it is of another component and may be as similar as asked. A class has many keys and so
    many hubs: of two components with many links at least one is found, from no more rows than there are."""
    columns, rank = ("node", "n_shingles", "component", "place", *SKETCH), F.xxhash64("key", "node", F.lit(turn))
    hub = rows.groupBy("key").agg(*(F.max_by(c, rank).alias(f"{c}_2") for c in columns))
    near = rows.join(hub, "key").filter(allowed(similar, deviations)).groupBy("node").agg(F.min_by("node_2", F.expr(BITS)).alias("other"))
    return near.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def across(rows: DataFrame, similar: int, deviations: float | None) -> DataFrame:
    """Pairs (a, b) of classes of different components that share a prefix key and may be as similar as asked. A key that many classes
    have is one that Spark's skew join splits: the condition is part of the join."""
    other = rows.select("key", *(F.col(c).alias(f"{c}_2") for c in ("node", "n_shingles", "component", "place", *SKETCH)))
    met = rows.join(other, "key").filter(f"node < node_2 and {allowed(similar, deviations)}")
    return met.select(F.col("node").alias("a"), F.col("node_2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, similar: int = SIMILAR, turns: int = PIVOT_TURNS, deviations: float | None = DEVIATIONS, hashes: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links lead to, its own included) and kept (whether that is its own)
    for each row of docs (doc_id, text): links join documents of which 100 * common >= similar * all shingles. With hashes a column
    text_hash tells rows of one doc_id apart. The result is a table in the shared folder, where it stays."""
    scratch = Scratch(docs.sparkSession, "minhash")
    base = scratch.save("signed", signed(docs, words))
    classes = scratch.save("classes", classed(base))
    crowd = scratch.save("crowd", crowded(classes))
    full = scratch.save("sets", full_sets(crowd, docs, words))
    linked = Components(scratch, classes.select("node", F.col("node").alias("component")).limit(0))
    met = scratch.save("met-0", mixed(keyed(crowd).withColumn("component", F.col("node"))))
    for turn in range(turns):
        pairs = scratch.save(f"pairs-{turn}", pivots(met, crowd, turn, similar))
        linked.add(confirmed(pairs, full, similar))
        met = scratch.save(f"met-{turn + 1}", mixed(linked.of(met.drop("component"))))
        scratch.drop(f"met-{turn}", f"pairs-{turn}")
    nodes = met.select("node").distinct()
    rest = scratch.save("rest", sketched(crowd.select("node", "n_shingles").join(nodes, "node").join(full, "node")))
    if not rest.isEmpty():
        prefix = scratch.save("prefixes", prefixes(rest, similar))
        # Hubs first: parts of one large group would meet below pair by pair.
        for turn in range(HUB_TURNS):
            links = scratch.save(f"hubs-{turn}", confirmed(hubs(mixed(linked.of(prefix)), similar, deviations, turn), full, similar))
            if links.isEmpty():
                break
            linked.add(links)
        # The likely pairs next: the components that they join leave fewer pairs for the whole range.
        for k, d in enumerate((0, deviations)):
            pairs = scratch.save(f"across-{k}", across(linked.of(prefix), similar, d))
            linked.add(confirmed(pairs, full, similar))
    smallest = linked.of(classes.select("node", "doc", "set_1", "set_2"))
    smallest = smallest.join(smallest.groupBy("component").agg(F.min("doc").alias("smallest")), "component").select("set_1", "set_2", "smallest")
    result = base.select("doc_id", "n_shingles", "text_hash", "set_1", "set_2").join(smallest, ["set_1", "set_2"], "left")
    component = F.coalesce("smallest", "doc_id")
    result = result.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *(["text_hash"] if hashes else []))
    result = scratch.save("result", result)
    scratch.drop("signed", "classes", "crowd", "sets", f"met-{turns}", "rest", "prefixes", "across-0", "across-1", *(f"hubs-{turn}" for turn in range(HUB_TURNS)), *linked.tables())
    return result

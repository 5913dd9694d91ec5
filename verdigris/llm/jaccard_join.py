"""Exact similarity join of documents on the Jaccard index of their word n-grams.

Two sets of similarity t or more share a token among the first d + 1 of each, d being how many tokens
the set can have without the other, under any order of all tokens.  Several orders are used and all
have to agree: rarest first, and twice rarest first by powers of two with the ties broken otherwise.
Rarity is counted for a fixed share of all tokens by hash, which comes first in every order; the
share is wide enough to hold the d + 1 tokens of nearly every set, and a set with too few goes on with
further tokens by hash.  Tokens of one set alone cannot be shared and drop out.

Sets that share a prefix token of the first order meet.  Of each group, pairs pass that also share a
prefix token of the other orders and whose token histograms are near enough, which never refuses a
similar pair.  Only a spanning tree of these pairs is verified with the full sets, and of the trees of
different groups only the edges that join what is not yet joined.  Where a tree edge
fails, the members that lie outside their group's main component propose their nearest other pairs.
Groups in which one of these fails too, or that had more to propose, come together a last time with the
full sets, and all passing pairs between components are verified until these have joined or none is
left.  So no link between components is lost, and a group of many copies costs a tree, not all its pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import RollingHash, bound_batches, digest, distinct_texts, join_groups, mix64, parts_by_bytes, shared_dir, take_worker, tasks_for, text_or_empty, tidy, written
from .components import connected_components, near_components

#: Words of a shingle, and the least similarity in hundredths.
WORDS, PERCENT = 5, 80
#: Bins of a token histogram for each token that a set may lack, and their least and largest number.
BINS_PER_MISSING, BINS_LEAST, BINS_MOST = 10, 256, 16384
#: Bits that mark the prefix tokens of a further order.
MARKS = 1024
#: Members of a group in one task; larger groups are compared block by block.
GROUP_MOST = 2048
#: Further pairs that one member of a group proposes.
PROPOSALS = 16
_CHUNK = 250_000
#: Bytes of words that a polynomial hash tells apart.
_LONG = 256

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles; fewer words than a shingle has make one."""
    out: list[np.ndarray] = []
    for part in parts_by_bytes(np.array([len(t) for t in texts], np.int64), _CHUNK):
        some = texts[part]
        data = _LOWER[np.frombuffer(b" ".join(some) + b" ", np.uint8)]
        inside = np.concatenate([[False], ~_SPACE[data]])
        starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        word = RollingHash(data).slices(starts, ends)
        for i in np.flatnonzero(ends - starts > _LONG).tolist():  # of long words some are known that a polynomial confuses
            word[i] = xxh3_64_intdigest(data[starts[i] : ends[i]])
        text_ends = np.cumsum([len(t) + 1 for t in some])
        bounds = np.searchsorted(starts, text_ends, side="left").tolist()
        rolled = word.copy()
        for j in range(1, words):
            rolled[: len(word) - j] = mix64(rolled[: len(word) - j] * np.uint64(0x9E3779B97F4A7C15) + word[j:])
        low = 0
        for high in bounds:
            n = high - low
            if n >= words:
                out.append(np.unique(rolled[low : high - words + 1]))
            elif n:
                h = word[low : low + 1]
                for j in range(1, n):
                    h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + word[low + j : low + j + 1])
                out.append(h ^ np.uint64(n))
            else:
                out.append(np.zeros(0, np.uint64))
            low = high
    return out


def missing_most(n: int, percent: int) -> int:
    """How many tokens of n a similar set can lack at most."""
    return n - -(-percent * n // 100)


def first_share(percent: int) -> int:
    """Tokens below this come first in every order: twice the share that prefixes need."""
    return min((1 << 32) - 1, (1 << 32) * 2 * (100 - percent) // 100 + (1 << 25))


def tokens_of(shingles: np.ndarray) -> np.ndarray:
    """32-bit images of the shingles, sorted and distinct.  Images of different sets differ in no more tokens than the sets."""
    t = (shingles >> np.uint64(32)).astype(np.uint32)
    return t[np.concatenate([[True], t[1:] != t[:-1]])] if len(t) else t


def counted_tokens(shingles: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """(the tokens that a set sends to be counted, how many of them come first in every order)."""
    t = tokens_of(shingles)
    first = int(np.searchsorted(t, np.uint32(first_share(percent))))
    return t[: max(first, missing_most(len(shingles), percent) + 1)], first


def prefixes(counted: np.ndarray, first: int, frequency: np.ndarray, length: int) -> list[np.ndarray] | None:
    """The shared tokens of the prefix of each order; None if one order has none, as then nothing is similar."""
    head, often, out = counted[:first], frequency[:first], []
    level = np.log2(often).astype(np.int64) if first else often
    for order in (np.lexsort((head, often)), np.lexsort((head * np.uint32(0x85EBCA6B) ^ np.uint32(0x5BD1E995), level)), np.lexsort((head * np.uint32(0xC2B2AE35) ^ np.uint32(0x27D4EB2F), level))):
        at = np.concatenate([order, np.arange(first, len(counted))])[:length]
        shared = counted[at[frequency[at] > 1]]
        if not len(shared):
            return None
        out.append(shared)
    return out


# ---- counting ---------------------------------------------------------------------------------------


def _bucket_rows(names: list[str], bucket: np.ndarray, *columns: np.ndarray):
    """One row for each bucket, the values of its members packed."""
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    cut = np.flatnonzero(np.diff(bucket)) + 1
    bounds = np.concatenate([[0], cut, [len(bucket)]])
    packed = [[c[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(bucket[bounds[:-1]], pa.int32()), *[pa.array(p, pa.binary()) for p in packed]], names)


def _count_rows(words: int, percent: int, buckets: int):
    def run(batches):
        take_worker("jaccard_join")
        for batch in batches:
            bodies, ids = batch.column("body").to_pylist(), batch.column("tid").to_numpy()
            for at in range(0, len(bodies), 2000):
                sets = [counted_tokens(s, percent)[0] for s in shingle_sets(bodies[at : at + 2000], words)]
                token = np.concatenate(sets)
                owner = np.repeat(ids[at : at + 2000], [len(s) for s in sets])
                # ids of one stored part are near each other
                for base in np.unique(owner >> 31):
                    own = owner >> 31 == base
                    t, o = token[own], (owner[own] & 0x7FFFFFFF).astype(np.uint32)
                    rows = _bucket_rows(["bucket", "token", "owner"], (t * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.int32) % buckets, t, o)
                    yield rows.append_column("base", pa.array(np.full(rows.num_rows, base), pa.int64()))

    return run


def _frequency_rows(buckets: int):
    def run(batches):
        take_worker("jaccard_join")
        tokens, owners = [], []
        for batch in batches:
            for base, t, o in zip(batch.column("base").to_pylist(), batch.column("token").to_pylist(), batch.column("owner").to_pylist(), strict=True):
                tokens.append(np.frombuffer(t, np.uint32))
                owners.append((base << 31) + np.frombuffer(o, np.uint32).astype(np.int64))
        if not tokens:
            return
        token, owner = np.concatenate(tokens), np.concatenate(owners)
        del tokens, owners
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        edges = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
        times = np.repeat(np.diff(edges), np.diff(edges))
        again = times > 1
        token, owner, times = token[again], owner[again], times[again].astype(np.uint32)
        if len(token):
            yield _bucket_rows(["bucket", "owner", "token", "times"], ((owner * 0x9E3779B1 >> 7) % buckets).astype(np.int32), owner, token, times)

    return run


def _owner_rows(batches):
    owners, tokens, times = [], [], []
    for batch in batches:
        owners += [np.frombuffer(x, np.int64) for x in batch.column("owner").to_pylist()]
        tokens += [np.frombuffer(x, np.uint32) for x in batch.column("token").to_pylist()]
        times += [np.frombuffer(x, np.uint32) for x in batch.column("times").to_pylist()]
    if owners:
        owner, token, often = np.concatenate(owners), np.concatenate(tokens), np.concatenate(times)
        order = np.argsort(owner, kind="stable")
        owner, token, often = owner[order], token[order], often[order]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]])
        for low in range(0, len(cut) - 1, 5000):
            spans = list(zip(cut[low : low + 5001][:-1].tolist(), cut[low : low + 5001][1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(owner[[a for a, _ in spans]], pa.int64()), pa.array([token[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([often[a:b].tobytes() for a, b in spans], pa.binary())],
                ["tid", "token", "times"],
            )


_PROFILE = "digest binary, copies long, n long, keys array<long>, second binary, third binary, bins binary, shingles array<long>"


def histogram(shingles: np.ndarray, bins: int) -> np.ndarray:
    """Tokens by their last bits; what is over 255 is cut, which brings two histograms nearer, never apart."""
    return np.minimum(np.bincount((shingles % np.uint64(bins)).astype(np.int64), minlength=bins), 255).astype(np.uint8)


def bins_for(n: int, percent: int) -> int:
    return min(BINS_MOST, max(BINS_LEAST, 1 << max(0, BINS_PER_MISSING * n * (100 - percent) // 100 - 1).bit_length()))


def marks(tokens: np.ndarray) -> bytes:
    """A bit for each token; sets that share a token share a bit."""
    bits = np.zeros(MARKS, bool)
    bits[(tokens * np.uint32(0x9E3779B1)) >> np.uint32(32 - MARKS.bit_length() + 1)] = True
    return np.packbits(bits).tobytes()


def _profile_rows(words: int, percent: int, bins_of):
    def run(batches):
        take_worker("jaccard_join")
        for batch in batches:
            bodies = batch.column("body").to_pylist()
            shared, often = batch.column("token").to_pylist(), batch.column("times").to_pylist()
            for at in range(0, len(bodies), 2000):
                sets = shingle_sets(bodies[at : at + 2000], words)
                out = {k: [None] * len(sets) for k in ("keys", "second", "third", "bins", "shingles")}
                for i, s in enumerate(sets):
                    if shared[at + i] is None or not len(s):
                        continue
                    counted, first = counted_tokens(s, percent)
                    times = np.ones(len(counted), np.int64)
                    known = np.frombuffer(shared[at + i], np.uint32)
                    times[np.searchsorted(counted, known)] = np.frombuffer(often[at + i], np.uint32)
                    found = prefixes(counted, first, times, missing_most(len(s), percent) + 1)
                    if found is None:
                        continue
                    out["keys"][i] = found[0].astype(np.int64)
                    out["second"][i], out["third"][i] = marks(found[1]), marks(found[2])
                    out["bins"][i] = histogram(s, bins_of(len(s), percent)).tobytes()
                    out["shingles"][i] = s.view(np.int64)
                part = batch.slice(at, len(sets))
                yield pa.RecordBatch.from_arrays(
                    [part.column("digest"), part.column("copies"), pa.array([len(s) for s in sets], pa.int64()), pa.array(out["keys"], pa.list_(pa.int64())), *[pa.array(out[k], pa.binary()) for k in ("second", "third", "bins")], pa.array(out["shingles"], pa.list_(pa.int64()))],
                    ["digest", "copies", "n", "keys", "second", "third", "bins", "shingles"],
                )

    return run


def profiles(texts: DataFrame, path: str, words: int, percent: int) -> DataFrame:
    """One row per stored text (digest, tid, text, copies): its set's size and, where similar sets may exist, its prefixes, histogram and shingles."""
    parts = tasks_for(texts)
    buckets = 4 * parts
    bodies = texts.select("tid", F.col("text").cast("binary").alias("body"))
    counted = bodies.mapInArrow(_count_rows(words, percent, buckets), "bucket int, token binary, owner binary, base long").repartition(parts, "bucket")
    again = counted.mapInArrow(_frequency_rows(buckets), "bucket int, owner binary, token binary, times binary").repartition(parts, "bucket")
    by_text = again.mapInArrow(_owner_rows, "tid long, token binary, times binary")
    named = by_text.join(texts.select("tid", "digest"), "tid").drop("tid")
    joined = texts.select("digest", "copies", F.col("text").cast("binary").alias("body")).join(named.hint("shuffle_hash"), "digest", "left")
    return written(joined.mapInArrow(_profile_rows(words, percent, bins_for), _PROFILE), f"{path}/profiles")


# ---- candidates -------------------------------------------------------------------------------------


class Group:
    """Members that share a prefix token."""

    def __init__(self, rows: pd.DataFrame, percent: int):
        self.percent = percent
        self.n = rows["n"].to_numpy(np.int64)
        self.marks = [np.frombuffer(b"".join(rows[c]), np.uint8).reshape(len(rows), -1) for c in ("second", "third")]
        self.width = rows["bins"].map(len).to_numpy(np.int64)
        self.place, self.bins = np.zeros(len(rows), np.int64), {}
        for w in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == w)
            self.place[at] = np.arange(len(at))
            self.bins[w] = np.frombuffer(b"".join(rows["bins"].iloc[at]), np.uint8).reshape(len(at), w)

    def distances(self, i: int, others: np.ndarray) -> np.ndarray:
        """How many tokens i and each of others have apart, at least: histograms of unlike width are folded."""
        out, own = np.zeros(len(others), np.int64), self.bins[self.width[i]][self.place[i]].astype(np.int16)[None]
        for w, table in self.bins.items():
            at = np.flatnonzero(self.width[others] == w)
            for low in range(0, len(at), 512):
                some = at[low : low + 512]
                theirs, mine = table[self.place[others[some]]].astype(np.int16), own
                while theirs.shape[1] > mine.shape[1]:
                    theirs = theirs[:, : theirs.shape[1] // 2] + theirs[:, theirs.shape[1] // 2 :]
                while mine.shape[1] > theirs.shape[1]:
                    mine = mine[:, : mine.shape[1] // 2] + mine[:, mine.shape[1] // 2 :]
                out[some] = np.abs(theirs - mine).sum(1, dtype=np.int64)
        return out

    def passing(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of others that all filters let pass with i, nearest first."""
        n, m = self.n[i], self.n[others]
        fits = 100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)
        others = others[fits]
        if not len(others):
            return others
        for m in self.marks:
            others = others[(m[others] & m[i]).any(1)]
        apart = self.distances(i, others)
        near = (100 + self.percent) * apart <= (100 - self.percent) * (n + self.n[others])
        others, apart = others[near], apart[near]
        return others[np.argsort(apart, kind="stable")]

    def tree(self) -> list[tuple[int, int]]:
        """Edges of a spanning forest of the passing pairs."""
        left, out = np.arange(len(self.n)), []
        while len(left) > 1:
            todo, left = [int(left[0])], left[1:]
            while todo and len(left):
                i = todo.pop()
                found = self.passing(i, left)
                if len(found):
                    out += [(i, int(j)) for j in found]
                    todo += found[::-1].tolist()
                    left = left[~np.isin(left, found)]
        return out

    def further(self, label: list, most: int) -> tuple[list[tuple[int, int]], bool]:
        """Passing pairs between components, `most` for each member outside the main one at most; whether there are more."""
        names: dict = {}
        part = np.array([names.setdefault(x, len(names)) for x in label])
        out, everyone, more = [], np.arange(len(self.n)), False
        main = int(np.bincount(part).argmax())
        for i in np.flatnonzero(part != main).tolist():
            found = self.passing(i, everyone[(part != part[i]) & ((part == main) | (everyone > i))])
            more |= len(found) > most
            out += [(i, int(j)) for j in found[:most]]
        return out, more

    def joining(self, label: list, shingles: list[np.ndarray]) -> list[tuple[int, int]]:
        """Verified links that join components, given by label: in the end no similar pair lies in two components."""
        names: dict = {}
        part = np.array([names.setdefault(x, len(names)) for x in label])
        out, everyone = [], np.arange(len(self.n))
        main = int(np.bincount(part).argmax())
        for i in np.flatnonzero(part != main).tolist():
            for j in self.passing(i, everyone[part != part[i]]).tolist():
                if part[j] == part[i]:
                    continue
                a, b = shingles[i], shingles[j]
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= self.percent * (len(a) + len(b) - both):
                    out.append((i, j))
                    part[part == part[j]] = part[i]
        return out


def _groups(batches):
    """The groups of a partition sorted by token and blocks."""
    held = None
    for pdf in batches:
        held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        name = held[["token", "low", "high"]].to_numpy()
        cut = np.flatnonzero((name[1:] != name[:-1]).any(1)) + 1
        at = 0
        for c in cut.tolist():
            yield held.iloc[at:c]
            at = c
        held = held.iloc[at:].reset_index(drop=True)
    if held is not None and len(held):
        yield held


_EDGE = "token long, low int, high int, a binary, b binary, more boolean"


def _edge_rows(percent: int, kind: str, most: int):
    """Edges of each group: `tree` of passing pairs, `further` pairs, or verified links `joining` components."""

    def run(batches):
        take_worker("jaccard_join")
        out, columns = [], ["token", "low", "high", "a", "b", "more"]
        for rows in _groups(batches):
            rows = rows.reset_index(drop=True)
            if len(rows) < 2:
                continue
            group, names, more = Group(rows, percent), rows["digest"].tolist(), False
            if kind == "tree":
                edges = group.tree()
            elif kind == "further":
                edges, more = group.further(rows["label"].tolist(), most)
            else:
                edges = group.joining(rows["label"].tolist(), rows["shingles"].tolist())
            head = rows.iloc[0]
            out += [(head["token"], head["low"], head["high"], names[i], names[j], more) for i, j in edges]
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if out:
            yield pd.DataFrame(out, columns=columns)

    return run


def _memberships(some: DataFrame, group_most: int) -> DataFrame:
    """(token, low, high, digest): one group for each different set of members; large groups once for each pair of blocks."""
    keys = some.select(F.explode("keys").alias("token"), "digest")
    marks = [F.sum(F.xxhash64("digest", F.lit(s)) % (1 << 52)) for s in (1, 2)]
    groups = keys.groupBy("token").agg(F.count(F.lit(1)).alias("size"), *[m.alias(f"mark{i}") for i, m in enumerate(marks)]).filter("size > 1")
    chosen = groups.groupBy("size", "mark0", "mark1").agg(F.min("token").alias("token")).select("token", "size")
    member = keys.join(chosen, "token")
    blocks = F.ceil(F.col("size") / group_most).cast("int")
    mine = F.when(F.col("size") > group_most, F.pmod(F.xxhash64("digest"), blocks)).otherwise(0).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("size") > group_most, blocks - 1).otherwise(0)))
    member = member.withColumn("mine", mine).withColumn("other", other)
    # a pair of two blocks holds both, so its own blocks need no group of their own unless there is one block
    return member.filter("size <= %d or mine <> other" % group_most).select("token", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "digest")


def similar_links(some: DataFrame, path: str, percent: int, group_most: int = GROUP_MOST) -> DataFrame | None:
    """(node, component) of the profiles that are similar to others; None if there can be none."""
    spark = some.sparkSession
    member = written(_memberships(some, group_most), f"{path}/members")
    if member.isEmpty():
        return None
    tidy(spark)
    parts, group = tasks_for(some), ["token", "low", "high"]
    facts = ["digest", "n", "second", "third", "bins"]
    sets = some.select("digest", "n", "shingles")
    left, right = (sets.select(*[F.col(c).alias(f"{c}_{s}") for c in sets.columns]) for s in ("a", "b"))

    def edges_of(rows: DataFrame, kind: str) -> DataFrame:
        ordered = rows.repartition(parts, *group).sortWithinPartitions(*group, "n", "digest")
        return written(ordered.mapInPandas(_edge_rows(percent, kind, PROPOSALS), _EDGE), f"{path}/{kind}")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        tried = pairs.select("a", "b").distinct().join(left, F.col("a") == F.col("digest_a")).join(right, F.col("b") == F.col("digest_b"))
        both = F.size(F.array_intersect("shingles_a", "shingles_b"))
        same = written(tried.select("a", "b", (100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)).alias("similar")), f"{path}/{name}")
        tidy(spark)
        return same

    def labelled(rows: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """Rows with a label; nodes of one label are connected, those of two may be."""
        label = written(near_components(links), f"{path}/{name}")
        return rows.join(label, F.col("digest") == F.col("node"), "left").withColumn("label", F.coalesce("component", "digest")).drop("node", "component")

    tree = edges_of(member.join(some.select(*facts), "digest"), "tree")
    tidy(spark)  # the histograms that were dealt out go before the sets are
    # one edge of each node first; most others then lie inside a component
    pairs = tree.select("a", "b").distinct()
    first = pairs.groupBy("b").agg(F.min("a").alias("a"))
    same = verified(first, "verified1")
    label = written(near_components(same.filter("similar")), f"{path}/labels0")
    of = lambda end: label.select(F.col("node").alias(end), F.col("component").alias(f"part_{end}"))
    rest = pairs.join(first, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
    rest = rest.filter(F.coalesce("part_a", "a") != F.coalesce("part_b", "b"))
    same = same.unionByName(verified(rest, "verified1b"))
    links, bad = same.filter("similar").select("a", "b"), same.filter("not similar").select("a", "b")
    if not bad.isEmpty():
        # groups in which a tree edge failed may hold other links between their components
        failed = written(member.join(tree.join(bad, ["a", "b"], "left_semi").select(*group).distinct(), group, "left_semi"), f"{path}/failed")
        further = edges_of(labelled(failed.join(some.select(*facts), "digest"), links, "labels1"), "further")
        same = verified(further, "verified2")
        links, bad = links.unionByName(same.filter("similar").select("a", "b")), same.filter("not similar").select("a", "b")
        still = further.join(bad, ["a", "b"], "left_semi").select(*group).unionByName(further.filter("more").select(*group)).distinct()
        rows = failed.join(still, group, "left_semi").join(some.select(*facts, "shingles"), "digest")
        links = links.unionByName(edges_of(labelled(rows, links, "labels2"), "joining").select("a", "b"))
        tidy(spark)
    return connected_components(links, f"{path}/labels")


def _classes(docs: DataFrame, path: str, text: str, words: int, percent: int, group_most: int) -> tuple[DataFrame, DataFrame]:
    """(stored texts, (digest, copies, n, label)): label is the least digest of the text's component."""
    bound_batches(docs.sparkSession)
    texts = distinct_texts(docs, f"{path}/texts", text)
    found = profiles(texts, path, words, percent)
    tidy(docs.sparkSession)
    parts = similar_links(found.filter(F.col("keys").isNotNull()), path, percent, group_most)
    known = found.select("digest", "copies", "n")
    if parts is None:
        return texts, known.withColumn("label", F.col("digest"))
    label = parts.select(F.col("node").alias("digest"), "component")
    return texts, known.join(label, "digest", "left").select("digest", "copies", "n", F.coalesce("component", "digest").alias("label"))


def join_similar(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text", group_most: int = GROUP_MOST) -> DataFrame:
    """Per row: key, n_shingles, component_id (the least key that links reach, itself included).

    Rows whose texts have no words, or are null, have no shingles and stand alone.  Equal texts are one
    class from the start.  Keys may be null or repeated; null keys name no component unless nothing
    else does.  An empty table gives no rows.
    """
    path = shared_dir(docs.sparkSession)
    _, classes = _classes(docs, path, text, words, percent, group_most)
    rows = docs.select(F.col(key).alias("key"), digest(text_or_empty(text)).alias("digest"))
    least = rows.groupBy("digest").agg(F.min("key").alias("least"))
    known = written(classes.join(least, "digest"), f"{path}/classes")
    ids = known.groupBy("label").agg(F.min("least").alias("component_id"))
    named = written(known.join(ids, "label").select("digest", "copies", F.col("n").alias("n_shingles"), "component_id"), f"{path}/named")
    out = join_groups(rows, named, ["digest"], "copies", ["n_shingles", "component_id"])
    return out.select(F.col("key").alias(key), "n_shingles", F.when(F.col("n_shingles") == 0, F.col("key")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text", group_most: int = GROUP_MOST, path: str | None = None) -> DataFrame:
    """One row of each component, that with the least key, and every row without words; the columns of docs.

    Of repeated rows with the least key one stays.  Columns must be of types that can be ordered.
    path: a folder for tables that the result reads, which may go once the result is written.
    """
    path = path or shared_dir(docs.sparkSession)
    texts, classes = _classes(docs, path, text, words, percent, group_most)
    others = [c for c in docs.columns if c not in (key, text)]
    # the least row of each text, without its text
    first = docs.groupBy(digest(text_or_empty(text)).alias("digest")).agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])).alias("row"))
    known = written(classes.filter("n > 0").join(first, "digest"), f"{path}/classes")
    best = known.groupBy("label").agg(F.min(F.struct("row", "digest")).alias("best")).select("best.*")
    kept = texts.select("digest", "text").join(best.hint("shuffle_hash"), "digest")
    columns = {key: F.col("row.key"), text: F.col("text")} | {c: F.col(f"row.c{i}") for i, c in enumerate(others)}
    kept = kept.select(*[columns[c].alias(c) for c in docs.columns])
    wordless = docs.filter(~text_or_empty(text).rlike(r"[^\x20\x09-\x0D]"))
    return kept.unionByName(wordless)

"""SimHash near-duplicates with BK-trees.

A document's 64-bit fingerprint is the majority vote of its shingles' hashes.
Distinct fingerprints are dealt to shards: the 64 bits fall into `blocks` blocks, and
two fingerprints that differ in at most `radius` bits agree on all of some
`blocks - radius` of them, so a shard for each choice of blocks and each value there
holds both (the pigeonhole principle: no link is lost).  Each shard keeps a BK-tree,
whose children hang at their integer Hamming distance to the parent; a search follows
only the edges within the radius of its own distance.

A subtree under an edge of at most `radius` lies wholly within reach of the parent,
so it is one component: a fingerprint that belongs to that component skips it, and any
other leaves it at the first hit.  A dense group of near copies thus costs neither all
its pairs nor all their links; each shard reports one link per fingerprint and
component it meets, and components() joins the shards.

The trees of all shards together grow with the corpus, so they are not broadcast to
every executor: shards and the fingerprints that search them meet by a shuffle.

Cases: a null or blank text has fingerprint zero and links like any other; a text of
fewer words than a shingle is one shingle; repeated rows and equal texts share a
fingerprint; rows with a null doc_id take part and get the smallest id they reach,
null if there is none; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import materialize, of_user, release, text_of, with_user, written
from tagloom.llm.graph import components


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `width` words, A-Z in lower case."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(width, len(words)) - 1
    return np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(starts[: len(words) - k].tolist(), ends[k:].tolist())], np.uint64)


def fingerprint(text: str, width: int = 4) -> int:
    """The bits set in over half the shingles' hashes, as a signed 64-bit integer."""
    return majority(shingle_hashes(text, width))


def majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # 4 MB of bits at a time
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and fp for every row of docs."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return docs.select("doc_id", of(text_of()).alias("fp"))


def tree_links(values: list[int], radius: int, most: int | None = None) -> list[tuple[int, int]] | None:
    """Links that join every two of the distinct values within the radius, through
    others if need be: at most one for each value and component that it meets, to the
    nearest value met there.  None if more than `most` comparisons were needed."""
    n, left = len(values), most or 1 << 62
    above = list(range(n))

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    out: list[tuple[int, int]] = []
    children: list[dict[int, int]] = [{} for _ in range(n)]
    for x in range(1, n):
        v, todo = values[x], [(0, -1)]
        near: dict[int, tuple[int, int]] = {}  # component: distance, place
        while todo:
            node, home = todo.pop()
            if home >= 0 and top(home) in near:
                continue
            left -= 1
            d = (v ^ values[node]).bit_count()
            if d <= radius:
                near[top(node)] = min(near.get(top(node), (65, 0)), (d, node))
            for edge, child in children[node].items():
                if d - radius <= edge <= d + radius:
                    todo.append((child, node if edge <= radius else home))
        if left < 0:
            return None
        for root, (_, node) in near.items():
            above[max(root, top(x))] = min(root, top(x))
            out.append((v, values[node]))
        node = 0
        while True:
            d = (v ^ values[node]).bit_count()
            child = children[node].setdefault(d, x)
            if child == x:
                break
            node = child
    return out


def blocks_for(n: int, radius: int, size: int = 64) -> int:
    """So many blocks that shards of n even fingerprints hold about `size` at most."""
    blocks = radius + 2
    while n >> (64 * (blocks - radius) // blocks) > size:
        blocks += 1
    return blocks


def shard_keys(key: Column, fp: Column, blocks: int, radius: int) -> Column:
    """A key for each choice of blocks: the key so far, its number and the bits there."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    keys = []
    for i, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.xxhash64(key, F.lit(i), fp.bitwiseAND(F.lit(mask).cast("long"))))
    return F.array(*keys)


def near_links(fps: DataFrame, radius: int = 4, blocks: int | None = None, most: int = 4_000_000, largest: int = 200_000, last: int = 12) -> DataFrame:
    """Links a, b between the distinct values of fps.fp, enough to join all that lie
    within the radius.

    There are so many blocks that shards do not grow with the corpus.  A shard that
    holds more than `largest` values all the same, or whose tree takes more than `most`
    comparisons, is dealt anew by more blocks, which makes it smaller and loses no link
    either; only with `last` blocks is every shard searched to the end."""
    blocks = blocks_for(fps.count(), radius) if blocks is None else blocks
    keyed, links = fps.select(F.lit(0).cast("long").alias("key"), "fp"), None
    while True:
        final = blocks >= last
        found = materialize(_search(keyed, radius, blocks, None if final else most, None if final else largest))
        own = found.where("a is not null").select("a", "b")
        links = own if links is None else links.unionByName(own)
        rest = found.where("fp is not null").select("key", "fp")
        if final or rest.isEmpty():
            return links
        keyed, blocks = rest, blocks + 2


def _search(keyed: DataFrame, radius: int, blocks: int, most: int | None, largest: int | None) -> DataFrame:
    """a, b: the links that the BK-trees of all shards find; key, fp: the values of
    shards that were left."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, over = None, [], False
        out: list[tuple[int, int]] = []
        names = ["a", "b", "key", "fp"]

        def left(values: np.ndarray) -> pa.RecordBatch:
            none = pa.nulls(len(values), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, pa.array(np.full(len(values), key, np.int64)), pa.array(values)], names)

        def close() -> Iterator[pa.RecordBatch]:
            if len(group) < 2 or over:
                return
            values = sorted(set(group))
            found = tree_links([v & 0xFFFFFFFFFFFFFFFF for v in values], radius, most)
            if found is None:
                yield left(np.array(values, np.int64))
            else:
                out.extend(found)

        def flush() -> pa.RecordBatch:
            rows = np.array(out, np.uint64).reshape(-1, 2).astype(np.int64)
            out.clear()
            none = pa.nulls(len(rows), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), none, none], names)

        for batch in batches:
            keys, values = (batch.column(i).to_numpy() for i in (0, 1))
            cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]).tolist() if len(keys) else []
            for i, j in zip(cuts, [*cuts[1:], len(keys)]):
                if keys[i] != key:
                    yield from close()
                    key, group, over = keys[i], [], False
                if over:
                    yield left(values[i:j])
                    continue
                group.extend(values[i:j].tolist())
                if largest and len(group) > largest:
                    yield left(np.array(group, np.int64))
                    group, over = [], True
            if len(out) >= 10_000:
                yield flush()
        yield from close()
        yield flush()

    dealt = keyed.select(F.explode(shard_keys(F.col("key"), F.col("fp"), blocks, radius)).alias("key"), "fp")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(search, "a long, b long, key long, fp long")


def _components(each: DataFrame, distinct: DataFrame, links: DataFrame) -> DataFrame:
    """each (doc_id, fp) with component_id, the smallest doc_id that links reach."""
    roots = components(links)
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(lowest, "root").select(F.col("fp").alias("__fp"), "component_id")
    return each.join(named, F.col("fp") == F.col("__fp")).drop("__fp")


def near_groups(docs: DataFrame, width: int = 4, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that
    links reach, for every row of docs."""
    each = materialize(fingerprints(docs, width))
    distinct = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = _components(each, distinct, near_links(distinct.select("fp"), radius, blocks))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def common_shingles(docs: DataFrame, width: int, sample: int = 20_000, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes that occur in many of about `sample` distinct texts, ascending,
    and in how many.  They only order prefixes: any order finds the same links."""

    @F.pandas_udf("array<long>")
    def each(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: np.unique(shingle_hashes(t, width)).view(np.int64))

    every = max(1, docs.count() // sample)
    some = docs.select(text_of().alias("text")).withColumn("h", F.xxhash64("text")).where(F.pmod("h", F.lit(every)) == 0).dropDuplicates(["h"])
    counted = some.select(F.explode(each("text")).alias("s")).groupBy("s").count().where("count >= 4")
    rows = counted.orderBy(F.desc("count"), "s").limit(most).toPandas()
    found = rows["s"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(found)
    return found[order], rows["count"].to_numpy(np.int64)[order]


def prefixes(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """doc_id, fp (here a digest of the set of shingles), n (its size), its sketch,
    mark (the text's SimHash fingerprint, as fingerprints() has it), and prefix: the
    rarest shingles, so many that two sets as similar as that share one."""
    common, often = common_shingles(docs, width)

    @F.pandas_udf("fp long, n long, sketch binary, mark long, prefix array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        from xxhash import xxh64_intdigest

        rows = []
        for t in texts:
            held = np.unique(shingle_hashes(t, width))
            count = np.zeros(len(held), np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, held), len(common) - 1)
                count = np.where(common[at] == held, often[at], 0)
            n = len(held)
            first = n - least_overlap(n, similarity) + 1 if n else 0
            digest = np.uint64(xxh64_intdigest(held.tobytes(), 42)).astype(np.int64)
            rows.append((digest, n, sketch(held), fingerprint(t), held[np.lexsort((held, count))][:first].view(np.int64)))
        return pd.DataFrame(rows, columns=["fp", "n", "sketch", "mark", "prefix"])

    return docs.select("doc_id", of(text_of()).alias("f")).select("doc_id", "f.fp", "f.n", "f.sketch", "f.mark", "f.prefix")


def tree_pairs(marked: DataFrame, radius: int = 4) -> DataFrame:
    """Pairs a, b of the digests marked.fp that join what near_groups() joins by the
    fingerprints marked.mark: each digest with the least one of its fingerprint, and
    those of two fingerprints that the shards' BK-trees link."""
    marked = marked.distinct()
    least = materialize(marked.groupBy("mark").agg(F.min("fp").alias("least"), F.count(F.lit(1)).alias("sets")))
    links = near_links(least.select(F.col("mark").alias("fp")), radius)
    one, two = (least.select(F.col("mark").alias(k), F.col("least").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    linked = links.join(one, "a").join(two, "b").select("x", "y")
    within = marked.join(least.where("sets > 1"), "mark").select(F.col("least").alias("x"), F.col("fp").alias("y"))
    pairs = linked.unionByName(within).where("x != y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def least_overlap(n, similarity: float):
    """What a set of n shares at least with any set as similar as that."""
    return np.ceil(similarity * n - 1e-9).astype(np.int64) if isinstance(n, np.ndarray) else int(np.ceil(similarity * n - 1e-9))


def _may_match(n, at, m, bt, similarity: float):
    """Whether sets of n and m shingles whose first common one stands at `at` and `bt`
    can be as similar as that, by their sizes and by what follows there."""
    both = np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9)
    return (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9) & (np.minimum(n - at, m - bt) >= both)


def _values(column: pa.Array) -> np.ndarray | list:
    """The column for numpy: numbers, or a list of byte strings or arrays."""
    if pa.types.is_list(column.type):
        values, ends = column.values.to_numpy(), column.offsets.to_numpy()
        return [values[i:j] for i, j in zip(ends[:-1], ends[1:])]
    return column.to_pylist() if pa.types.is_binary(column.type) else column.to_numpy()


def by_token(rows: DataFrame, f, schema: str) -> DataFrame:
    """f over runs of whole groups of equal token, in order of token, n and fp; f takes
    arrays by column and the groups' first places, and yields record batches."""
    names = rows.columns

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
            arrays = {c: _values(table.column(c).combine_chunks()) for c in names}
            token = arrays["token"]
            if len(token):
                yield from f(arrays, np.flatnonzero(np.r_[True, token[1:] != token[:-1]]))

        for batch in batches:
            if not batch.num_rows:
                continue
            token = batch.column("token").to_numpy()
            cut = int(np.searchsorted(token, token[-1]))
            if held and held[0].column("token")[0].as_py() == token[-1]:
                held.append(batch)  # one group goes on through the whole batch
                continue
            yield from run(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = [batch.slice(cut)]
        if held:
            yield from run(pa.Table.from_batches(held))

    return rows.repartition("token").sortWithinPartitions("token", "n", "fp").mapInArrow(search, schema)


def shared_tokens(distinct: DataFrame, similarity: float) -> DataFrame:
    """token, fp, n and at for every prefix shingle that several sets hold; one and two
    are the group's first set and the one before, if they may match."""

    def several(x: dict[str, np.ndarray], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(np.r_[starts, len(x["token"])])
        first = np.repeat(starts, sizes)
        place = np.arange(len(first))
        before = np.maximum(first, place - 1)
        links = []
        for other in (first, before):
            fits = (other != place) & _may_match(x["n"], x["at"], x["n"][other], x["at"][other], similarity)
            links.append(pa.array(x["fp"][other], mask=~fits))
        keep = pa.array(np.repeat(sizes > 1, sizes))
        batch = pa.RecordBatch.from_arrays([*[pa.array(x[c]) for c in ("token", "fp", "n", "at")], *links], ["token", "fp", "n", "at", "one", "two"])
        yield batch.filter(keep)

    each = distinct.select("fp", "n", F.posexplode("prefix").alias("at", "token")).select("token", "fp", "n", F.col("at").cast("long").alias("at"))
    return by_token(each, several, "token long, fp long, n long, at long, one long, two long")


def _mixed(x: dict[str, np.ndarray], starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """The groups whose sets have several roots, as ranges of places."""
    if not len(starts):
        return
    ends = np.r_[starts[1:], len(x["token"])]
    own = x["root"] != np.repeat(x["root"][starts], ends - starts)
    some = np.logical_or.reduceat(own, starts)
    yield from zip(starts[some].tolist(), ends[some].tolist())


def _batch(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    both = [np.concatenate([p[k] for p in pairs]) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(*both)), pa.array(np.maximum(*both))], ["a", "b"])


def hub_pairs(shared: DataFrame, similarity: float, turn: int) -> DataFrame:
    """Pairs a, b that lead each set to the root that most sets of a group have: one
    with a set of that root near it in size (another one in each turn and group), and
    one with the set before; at most two for each token of a set."""

    def pairs(x: dict[str, np.ndarray], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        out = []
        for i, j in _mixed(x, starts):
            n, at, fp, root = (x[c][i:j] for c in ("n", "at", "fp", "root"))
            names, counts = np.unique(root, return_counts=True)
            home = root == names[counts.argmax()]
            hub, k = np.flatnonzero(home), np.flatnonzero(~home)
            turned = (fp[k] ^ x["token"][i]) * (2 * turn + 1) >> 11
            near = hub[np.clip(np.searchsorted(hub, k) + turned % 17 - 8, 0, len(hub) - 1)]
            before = np.maximum(k - 1, 0)
            for other in (near, before):
                fits = (root[other] != root[k]) & _may_match(n[other], at[other], n[k], at[k], similarity)
                if fits.any():
                    out.append((fp[other[fits]], fp[k[fits]]))
        if out:
            yield _batch(out)

    return by_token(shared.select("token", "fp", "n", "at", "root"), pairs, "a long, b long").distinct()


def crossings(shared: DataFrame) -> float:
    """In how many pairs of sets that share a token the roots differ (a pair counts for
    every token)."""
    each = shared.groupBy("token", "root").count().groupBy("token").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("same"))
    return each.agg(F.sum((F.col("n") * F.col("n") - F.col("same")).cast("double"))).first()[0] or 0.0


def sketch(held: np.ndarray, bits: int = 2048) -> bytes:
    """For each of `bits` classes of hashes, whether it holds an odd number of them.  Two
    sketches differ in at most as many bits as there are hashes in one set only."""
    odd = np.bincount((held % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def _marks(sketches) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)


def _near_marks(x: np.ndarray, y: np.ndarray, n, m, similarity: float) -> np.ndarray:
    """Whether sets of n and m shingles with those sketches can be as similar as that."""
    most = (1 - similarity) / (1 + similarity)
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= most * (n + m) + 1e-9


def possible(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose sketches (fp, n, sketch) leave it open that they are as
    similar as that; no pair that is gets lost.  A row carries one sketch of fixed size,
    where verified() sends a whole set of shingles."""

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="bool")
        return pd.Series(_near_marks(_marks(x.tolist()), _marks(y.tolist()), n.to_numpy(), m.to_numpy(), similarity))

    left, right = (sketches.select(F.col("fp").alias(k), F.col("sketch").alias(v), F.col("n").alias(c)) for k, v, c in (("a", "x", "p"), ("b", "y", "q")))
    return pairs.join(left, "a").join(right, "b").where(near("x", "y", "p", "q")).select("a", "b")


def cross_pairs(shared: DataFrame, similarity: float) -> DataFrame:
    """Pairs a, b of sets that share a token, may match and have different roots.  If
    shared has sketch, too, pairs that it rules out are left out.  Rows carry nothing
    that grows with the text, as a long one has many."""
    large = "sketch" in shared.columns

    def pairs(x: dict[str, np.ndarray], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for i, j in _mixed(x, starts):
            n, at, fp, root = (x[c][i:j] for c in ("n", "at", "fp", "root"))
            if large:
                marks = _marks(x["sketch"][i:j])
            for k in range(1, j - i):
                fits = np.flatnonzero((root[:k] != root[k]) & _may_match(n[:k], at[:k], n[k], at[k], similarity))
                if large and len(fits):
                    fits = fits[_near_marks(marks[fits], marks[k], n[fits], n[k], similarity)]
                if len(fits):
                    out.append((fp[fits], np.full(len(fits), fp[k])))
                    held += len(fits)
                if held >= 100_000:
                    yield _batch(out)
                    out, held = [], 0
        if out:
            yield _batch(out)

    columns = ["token", "fp", "n", "at", "root", *(["sketch"] if large else [])]
    return by_token(shared.select(*columns), pairs, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of digests whose texts (fp, text; one for each) have that
    Jaccard similarity of their sets of shingles, or more."""

    @F.pandas_udf("binary")
    def shingles(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: np.unique(shingle_hashes(t, width)).tobytes())

    @F.pandas_udf("double")
    def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x: bytes, y: bytes) -> float:
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            return both / max(1, len(p) + len(q) - both)

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")

    sets = materialize(texts.select("fp", shingles("text").alias("set")))
    left, right = sets.select(F.col("fp").alias("a"), F.col("set").alias("x")), sets.select(F.col("fp").alias("b"), F.col("set").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(jaccard("x", "y") >= similarity).select("a", "b")


def across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs a, b whose ends have different roots (a node without one is its own)."""
    one, two = (roots.select(F.col("node").alias(k), F.col("root").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    known = pairs.join(one, "a", "left").join(two, "b", "left")
    return known.where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b")


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, broadcast_rows: int = 1_000_000, turns: int = 8, small: int = 16) -> DataFrame:
    """docs without near duplicates: of each group the row with the smallest doc_id
    stays (a null id is greatest; ties go by a hash of the row), and rows that are
    equal in doc_id and text count once.

    Groups are what links of that Jaccard similarity or more join, none left out.
    First the fingerprints of all texts are searched by the BK-trees, as in
    near_groups(); the pairs they link are computed exactly, and what is verified is
    joined.  Fingerprints can't promise every link (at 0.8 they differ in nine or ten
    bits on average, in no fixed number at most, and a link that fails may hide
    another), so what crosses the groups so found is completed by sets that share a
    shingle of their prefixes: of n shingles in one order for all, the first
    n - ceil(similarity * n) + 1.  Sizes and places there rule out most of them; the
    rest is computed exactly, too.  First each set is held against two of those it shares
    a shingle with, and what is verified is joined.  While many candidates still cross
    the groups so found, further turns hold sets against members of the group that is
    the most frequent around them, so that a dense group costs few of its pairs.  Then
    every candidate across groups is verified, too: a pair is passed over only if
    verified links join it already, or if their sketches show that the two differ too
    much (inside the group where more than `small` sets share a shingle, else once the
    pair is made)."""
    keyed = with_user(docs)
    doc_id, text = F.col("user.doc_id"), F.col("user.text")
    named = keyed.select(F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), "row").alias("doc_id"), text.alias("text"))
    whole = materialize(prefixes(named, width, similarity))
    with_prefixes = written(docs.sparkSession)[-1:]
    firsts = materialize(whole.groupBy("fp").agg(F.min("doc_id").alias("first")))
    earlier = written(docs.sparkSession)
    trees = materialize(tree_pairs(whole.select("fp", "mark")))
    release(docs.sparkSession, [t for t in written(docs.sparkSession)[:-1] if t not in earlier])
    distinct = whole.groupBy("fp").agg(F.min("n").alias("n"), F.first("prefix").alias("prefix"))
    shared = materialize(shared_tokens(distinct, similarity))
    sharing = whole.select("fp", "n", "sketch").join(shared.select("fp").distinct(), "fp", "left_semi")
    sketches = materialize(sharing.dropDuplicates(["fp"]))
    each = materialize(whole.select("doc_id", "fp"))
    release(docs.sparkSession, with_prefixes)

    def texts_of(some: DataFrame) -> DataFrame:
        """fp and one text for each of the digests fp of some."""
        ends = materialize(some.distinct().join(firsts, "fp").select("fp", F.col("first.row").alias("end")))
        # else all texts are dealt to find the few
        hint = F.broadcast if ends.count() <= broadcast_rows else (lambda t: t)
        return keyed.select("row", F.coalesce(text, F.lit("")).alias("text")).join(hint(ends), F.col("row") == F.col("end")).dropDuplicates(["fp"])

    def holding(pairs: DataFrame, sketched: bool = True) -> DataFrame:
        before = written(docs.sparkSession)
        if sketched:
            pairs = materialize(possible(pairs, sketches, similarity))
        ends = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp")))
        out = materialize(verified(pairs, texts_of(ends), width, similarity))
        release(docs.sparkSession, [t for t in written(docs.sparkSession)[:-1] if t not in before])
        return out

    links = holding(trees, sketched=False)
    roots = components(links)
    two = shared.select("fp", F.explode(F.array("one", "two")).alias("other")).where("other is not null")
    near = two.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct()
    near = materialize(across(near, roots).join(trees, ["a", "b"], "left_anti"))
    tried, enough = trees.unionByName(near), shared.count() / 20
    found = holding(near)
    if not found.isEmpty():
        links = links.unionByName(found)
        roots = components(links)

    def rooted() -> DataFrame:
        return shared.join(roots, shared["fp"] == roots["node"], "left").select("token", "fp", "n", "at", F.coalesce("root", "fp").alias("root"))

    before = float("inf")
    for turn in range(turns):
        now = crossings(rooted())
        if now <= enough or now > 0.8 * before:
            break
        before = now
        pairs = materialize(hub_pairs(rooted(), similarity, turn).join(tried, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            break
        found, tried = holding(pairs), tried.unionByName(pairs)
        if not found.isEmpty():
            links = links.unionByName(found)
            roots = components(links)

    last = materialize(rooted())
    own = last.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("sets")).where("low != high")
    own = materialize(own.select(F.col("token").alias("own"), (F.col("sets") > small).alias("large")))
    few, many = (last.join(own.where(which), F.col("token") == F.col("own"), "left_semi") for which in ("not large", "large"))
    rest = cross_pairs(few, similarity)
    if not own.where("large").isEmpty():
        rest = rest.unionByName(cross_pairs(many.join(sketches.select("fp", "sketch"), "fp"), similarity)).distinct()
    rest = materialize(rest.join(tried, ["a", "b"], "left_anti"))
    groups = _components(each, firsts, links.unionByName(holding(rest)))
    kept = materialize(groups.where("doc_id = component_id").select(F.col("doc_id.row").alias("kept")).distinct())
    left = keyed.join(kept, F.col("row") == F.col("kept"), "left_semi")
    twice = materialize(each.groupBy(F.col("doc_id.row").alias("again")).count().where("count > 1").select("again"))
    if not twice.isEmpty():  # only rows that come twice are dealt by their key
        same = F.col("row") == F.col("again")
        left = left.join(twice, same, "left_anti").unionByName(left.join(twice, same, "left_semi").dropDuplicates(["row"]))
    return left.select(of_user(docs.columns))

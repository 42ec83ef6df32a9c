"""N-gram Jaccard join by vertical partitioning.

The n-grams of all documents have one global order, that of their 64-bit hashes. Cuts of this order make fragments;
a document's set falls into one segment a fragment.

1. Candidates. For documents of a size class the order is cut into more fragments than a pair at the threshold can
   have differing n-grams, so such a pair has at least one whole segment in common: only equal segments meet. Sizes
   form classes; a document is also cut by the next class if a partner there can be near enough. There are some more
   fragments than needed, so a near pair shares several segments, and each document sets aside as many of its commonest
   ones as leave one of them: a line that a third of all documents have brings no one together. Where so many of a
   document's segments are empty that the argument fails, its first n-grams in the order (the usual prefix) stand in.
2. Partial overlaps. Candidates are cut into a few fragments; each fragment counts its part of the overlap by itself,
   and the counts are summed per pair.
3. Links make components. Documents with equal sets stand together from the start. Of each bucket of equal segments,
   members are first held against the hub, the member that shares most segments with others over all its buckets (the
   original of a group of copies, say). Pairs of members that the links so found leave in different components meet
   again only if they can be near: within the hub's set they have no more in common than the one that has less in common
   with the hub, so either that is enough for their sizes, or they share n-grams outside of the hub's set, and then they
   meet on the first of these, as many as the missing overlap leaves; what they meet on must be enough for what is
   missing. Thousands of near copies thus cost about their
   number and not its square, and no link between different components is lost.

Defined results: null or empty text has an empty set (n_shingles 0) and is linked with nothing; fewer words than n
make one shingle of them all. Rows of one doc_id are one node; if their texts
differ, the set of fewest n-grams is the one compared. A row without doc_id takes no part (component_id
null). Other columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.shared import batched, components, free, table
from pulsegrid.llm.textkit import U, grouped, longs, mix, runs, shingles, words

#: Fragments of which each counts its own partial overlaps.
FRAGMENTS = 4
#: Members of one hub that a task compares; more are dealt to more tasks.
MEMBERS = 512
#: Places in which rows of a hub of many members look up their salts.
DEAL = 32
#: Members of one n-gram that meet in a task at a time; more are dealt to blocks, and each two blocks meet.
MEET = 4096
#: A size class spans this many steps of 1 / threshold.
STEPS = 2

#: Signatures meet in so many passes, each over its own ones: a power of 2.
PASSES = 4

_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("lead", pa.int64())])
_SIGNED = pa.schema([*_SETS, *(x for g in range(PASSES) for x in ((f"sigs{g}", pa.list_(pa.int64())), (f"tags{g}", pa.list_(pa.int32()))))])
_SQL = {pa.int64(): "long", pa.list_(pa.int64()): "array<long>", pa.list_(pa.int32()): "array<int>"}


def size_classes(largest: int, num: int, den: int) -> np.ndarray:
    """Lower bounds of the size classes: with sizes b <= a in reach, b is in a's class or the one before.

    The bounds go on for two classes past the largest size.
    """
    out, past = [1], 0
    while past < 3:
        x = out[-1]
        for _ in range(STEPS):
            x = max(x + 1, -(-x * den // num))
        out.append(x)
        past += x > largest
    return np.array(out)


def most_apart(hi: np.ndarray, num: int, den: int) -> np.ndarray:
    """The most n-grams in which two sets of at most hi n-grams may differ at the threshold num / den."""
    return (2 * hi * (den - num)) // (den + num)


def signatures(row: np.ndarray, value: np.ndarray, n: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature, tag): rows whose sets are at the threshold or over share at least one signature.

    A tag is 2 * spare, and 1 more for cuts by the next class: of the signatures with its tag, a row may set aside
    `spare`, the same way for all rows. row and value are sorted by both; n has the size of every row's set.
    """
    low = size_classes(int(n.max(initial=1)), num, den)
    own = np.searchsorted(low, n, "right") - 1
    rows, sigs, tags = [], [], []
    first = np.cumsum(n) - n
    for ahead in (0, 1):
        c = own + ahead
        c_hi = low[c + 1] - 1
        take = (n > 0) & (n * den >= num * low[c]) if ahead else n > 0
        apart = most_apart(c_hi, num, den)
        cuts = np.maximum(1, apart + apart // 4 + np.where(apart > 0, 2, 1)).astype(np.int64)
        mine = take[row]
        r, v = row[mine], value[mine]
        if not len(r):
            continue
        # The cut follows the order: fragment = floor(top 32 bits * cuts / 2^32).
        part = ((v >> U(32)) * cuts[r].astype(U)) >> U(32)
        at = runs(r, part)
        head = at[:-1]
        summed = np.add.reduceat(mix(v), head)
        of, tag = r[head], (c[r[head]].astype(U) << U(40)) ^ part[head].astype(U)
        rows.append(of)
        sigs.append(mix(summed ^ mix(tag + U(0x1F3D5B79))))
        filled = np.bincount(of, minlength=len(n))
        spare = np.maximum(filled - np.minimum(apart, n * (den - num) // num) - 1, 0)
        tags.append(2 * spare[of] + ahead)
        for i in np.flatnonzero(take & (filled <= np.minimum(apart, n * (den - num) // num))):  # too few segments are filled: prefix of the order
            k = int(min(n[i], most_apart(c_hi[i], num, den) + 1))
            rows.append(np.full(k, i))
            tags.append(np.full(k, ahead))
            sigs.append(mix(value[first[i] : first[i] + k] ^ mix(np.full(k, c[i], U) + U(0x7A5C3E11))))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(sigs), np.concatenate(tags)


def _digest(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int, lower: bool) -> Iterator[pa.RecordBatch]:
    """Each row's set by its digest; of equal sets of a task the first one leads, and only it has signatures."""
    seen: dict[tuple[int, int], int] = {}
    for batch in batches:
        ids = batch["doc_id"]
        for w in words(batch["text"], lower):
            row, value, n = shingles(w, k)
            k1, k2 = np.zeros(len(n), U), np.zeros(len(n), U)
            head = np.flatnonzero(n)
            if len(head):
                at = (np.cumsum(n) - n)[head]
                k1[head] = np.add.reduceat(mix(value), at)
                k2[head] = np.bitwise_xor.reduceat(mix(value + U(0x2545F4914F6CDD1D)), at)
            given = ids[w.rows].is_valid().to_numpy(zero_copy_only=False)
            numbers = ids[w.rows].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            new, lead = np.zeros(len(n), bool), numbers.copy()
            for i in head:
                if given[i]:
                    key = (int(k1[i]), int(k2[i]))
                    new[i] = key not in seen
                    lead[i] = seen.setdefault(key, int(numbers[i]))
            if len(seen) > 50_000:
                seen.clear()
            mine = new[row]
            again = np.where(new, n, 0)
            r, s, tag = signatures(row[mine], value[mine], again, num, den)
            lists, turn = [], s & U(PASSES - 1)
            for g in range(PASSES):
                mine = np.flatnonzero(turn == U(g))
                mine = mine[np.argsort(r[mine], kind="stable")]
                at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(r[mine], minlength=len(n)))]), pa.int32())
                lists += [pa.ListArray.from_arrays(at, longs(s[mine])), pa.ListArray.from_arrays(at, pa.array(tag[mine].astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([ids[w.rows].cast(pa.int64()), pa.array(n.astype(np.int64)), longs(k1), longs(k2), pa.array(lead, pa.int64(), mask=~given), *lists], schema=_SIGNED)


_PAIRS = pa.schema([("hub", pa.int64()), ("node", pa.int64())])


_MEMBERS = pa.schema([("sig", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("tag", pa.int32()), ("others", pa.int64())])
#: Others in a bucket that comes in parts.
_VAST = 1 << 31


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (sig, node): the buckets of two nodes or more, and how many others each node meets there."""
    for batch, begins, ends in grouped(batches, "sig"):
        sig, node = batch["sig"].to_numpy(), batch["node"].to_numpy()
        one = runs(sig, node)[:-1]
        at = runs(sig[one])
        others = np.repeat(np.diff(at) - 1, np.diff(at))
        if not (begins and ends):
            others[:] = _VAST
        keep = np.flatnonzero(others)
        if len(keep):
            rows = one[keep]
            yield pa.RecordBatch.from_arrays([pa.array(sig[rows]), pa.array(node[rows]), batch["n"].take(pa.array(rows)), batch["tag"].take(pa.array(rows)), pa.array(others[keep])], schema=_MEMBERS)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by sig with the hub first: the hub with every other node."""
    hub = None  # of a bucket that goes on
    for batch, begins, _ in grouped(batches, "sig"):
        sig, node = batch["sig"].to_numpy(), batch["node"].to_numpy()
        at = runs(sig)
        hubs = node[at[:-1]].copy()
        if not begins:
            hubs[0] = hub
        hub = hubs[-1]
        hubs = np.repeat(hubs, np.diff(at))
        keep = np.flatnonzero(hubs != node)
        if len(keep):
            pairs = pa.Table.from_arrays([pa.array(hubs[keep]), pa.array(node[keep])], schema=_PAIRS)
            yield from pairs.group_by(["hub", "node"]).aggregate([]).select(["hub", "node"]).cast(_PAIRS).combine_chunks().to_batches()


_MET = pa.schema([("via", pa.int64()), ("hub", pa.int64()), ("node", pa.int64()), ("asked", pa.int64())])


def _across(batches: Iterator[pa.RecordBatch], num: int, den: int, out: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (meet, comp): pairs of nodes of one meeting that are in different components.

    A meeting is of one block, all with all, or of two, each of the one with each of the other.
    asked: on how many of their first n-grams outside of the hub's set the two must meet.
    """
    for batch, _, _ in grouped(batches, "meet", 1 << 40):  # a meeting has two blocks at most
        meet, comp, node, via, n, common, least, block, two = (batch[c].to_numpy(zero_copy_only=False) for c in ("meet", "comp", "node", "hub", "n_node", "common", "least", "block", "two"))
        at = runs(meet)
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if hi - lo < 2 or comp[lo] == comp[hi - 1]:
                continue
            inner = (runs(comp[lo:hi]) + lo).tolist()
            for a, b in zip(inner[:-1], inner[1:], strict=True):
                for x in range(a, b) if b < hi else ():
                    for i in range(b, hi, out):
                        o = np.arange(i, min(i + out, hi))
                        if two[lo]:
                            o = o[block[o] != block[x]]
                            if not len(o):
                                continue
                        need = -(-num * (n[x] + n[o]) // (num + den)) - np.minimum(common[x], common[o])
                        asked = need - np.maximum(least[x], least[o]) + 1
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(asked), via[lo])), pa.array(np.minimum(node[x], node[o])), pa.array(np.maximum(node[x], node[o])), pa.array(asked)], schema=_MET)


def _meetings(beside: DataFrame) -> DataFrame:
    """Rows (sig, node, comp, ...) with meet, block and two: what meets in one task.

    Members of a signature that are all in one component are left out. Over MEET of them are dealt to blocks, and a
    meeting is of one block or of two, so the rows of a task stay bounded, however many share an n-gram.
    """
    sizes = beside.groupBy("sig").agg(F.count("*").alias("__n"), F.min("comp").alias("__a"), F.max("comp").alias("__b"))
    sizes = sizes.where("__a <> __b").select(F.col("sig").alias("__sig"), F.ceil(F.col("__n") / MEET).cast("int").alias("__blocks"))
    own = F.pmod(F.hash("node"), F.col("__blocks"))
    rows = beside.join(sizes, F.col("sig") == F.col("__sig")).withColumn("block", own)
    rows = rows.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    rows = rows.withColumn("two", F.col("block") != F.col("__other"))
    meet = F.xxhash64("sig", F.least("block", "__other"), F.greatest("block", "__other"))
    return rows.withColumn("meet", meet).drop("__sig", "__blocks", "__other", "sig")


_PARTS = pa.schema([("hub", pa.int64()), ("part", pa.int32()), ("salt", pa.int32()), ("member", pa.int8()), ("node", pa.int64()), ("n", pa.int64()), ("text", pa.int64()), ("grams", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _cut(batches: Iterator[pa.RecordBatch], k: int, lower: bool) -> Iterator[pa.RecordBatch]:
    """Each document's set, cut into fragments, once for every hub and salt it goes to."""
    for batch in batches:
        to, nodes, out, size = batch["dest"], batch["node"].to_numpy(), [], 0
        for w in words(batch["text"], lower):
            _, value, n = shingles(w, k)
            at = np.concatenate([[0], np.cumsum(n)])
            for i in range(len(n)):
                grams = value[at[i] : at[i + 1]]
                cuts = np.searchsorted((grams >> U(32)) * U(FRAGMENTS) >> U(32), np.arange(FRAGMENTS + 1))
                parts = [grams[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                node = int(nodes[w.rows.start + i])
                text = int(np.bitwise_xor.reduce(grams).view(np.int64)) if len(grams) else 0
                for d in to[w.rows.start + i].as_py():
                    out += [(d["hub"], p, d["salt"], d["member"], node, int(n[i]), text, parts[p]) for p in range(FRAGMENTS)]
                    size += 8 * int(n[i])
                    if size > 4 << 20:
                        yield _batch(out, _PARTS)
                        out, size = [], 0
        if out:
            yield _batch(out, _PARTS)


_COUNTS = pa.schema([("hub", pa.int64()), ("node", pa.int64()), ("part", pa.int32()), ("common", pa.int64()), ("n_hub", pa.int64()), ("n_node", pa.int64()), ("beside", pa.list_(pa.int64()))])


def _overlaps(batches: Iterator[pa.RecordBatch], num: int, den: int, beside: bool) -> Iterator[pa.RecordBatch]:
    """Partial overlaps within one fragment: the hub's segment comes first, its members' follow.

    Rows that repeat a node follow each other: the first counts. beside: also a member's first n-grams outside of the
    hub's set, as many as a pair through them can need.
    """
    hub: tuple | None = None
    grams, n_hub, last = np.zeros(0, U), 0, None
    for batch in batches:
        out = []
        for h, p, s, m, node, n, _, g in zip(*(batch[c].to_pylist() for c in _PARTS.names), strict=True):
            g = np.frombuffer(g, U)
            if not m:
                if hub != (h, p, s):
                    hub, grams, n_hub = (h, p, s), g, n
                last = None
            elif hub == (h, p, s) and node != last:
                last = node
                both = grams[np.minimum(np.searchsorted(grams, g), len(grams) - 1)] == g if len(grams) else np.zeros(len(g), bool)
                rest = []
                if beside:
                    rest = g[~both][: n - -(-num * n // den) + 1].view(np.int64)
                out.append((h, node, p, int(both.sum()), n_hub, n, rest))
        if out:
            yield _batch(out, _COUNTS)


def compared(docs: DataFrame, pairs: DataFrame, k: int, num: int, den: int, lower: bool, beside: bool) -> DataFrame:
    """Candidate pairs (hub, node) with their overlaps, summed over the fragments: common, n_hub, n_node, near."""
    salts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts"))
    # Only hubs of many members have more than one salt; their rows look it up in as many places.
    deal = F.pmod(F.hash("node"), F.lit(DEAL))
    many = salts.where("salts > 1").select(F.col("hub").alias("__hub"), "salts", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))).alias("__deal"))
    told = pairs.select("node", "hub", deal.alias("__at")).join(many, (F.col("hub") == F.col("__hub")) & (F.col("__at") == F.col("__deal")), "left")
    member = told.select("node", "hub", F.pmod(F.hash("node"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"), F.lit(1).cast("tinyint").alias("member"))
    hubs = salts.select(F.col("hub").alias("node"), "hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).cast("tinyint").alias("member"))
    dest = member.unionByName(hubs).groupBy(F.col("node").alias("__node")).agg(F.collect_list(F.struct("hub", "salt", "member")).alias("dest"))
    # The first time many texts are asked for: they move by a sort-merge join, the same way at every size.
    dest = dest.hint("merge") if beside else dest
    texts = docs.join(dest, docs["doc_id"] == dest["__node"]).select(F.col("doc_id").alias("node"), "text", "dest")
    parts = batched(texts, partial(_cut, k=k, lower=lower), "hub long, part int, salt int, member tinyint, node long, n long, text long, grams binary")
    order = ("hub", "part", "salt", "member", "node", "n", "text")
    parts = parts.repartition(*order[:3]).sortWithinPartitions(*order)
    each = batched(parts, partial(_overlaps, num=num, den=den, beside=beside), "hub long, node long, part int, common long, n_hub long, n_node long, beside array<long>")
    listed = [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "beside"))), lambda x: x["beside"])).alias("beside")] if beside else []
    counts = each.groupBy("hub", "node").agg(F.sum("common").alias("common"), F.max("n_hub").alias("n_hub"), F.max("n_node").alias("n_node"), *listed)
    out = counts.withColumn("near", F.col("common") * den >= num * (F.col("n_hub") + F.col("n_node") - F.col("common")))
    return out


def ngram_join(docs: DataFrame, *, n: int = 5, num: int = 8, den: int = 10, lower: bool = True) -> DataFrame:
    """Documents whose sets of n-word shingles have a Jaccard similarity of num / den or over, as components.

    Returns one row per row of docs (doc_id, text): doc_id, n_shingles, component_id (the smallest doc_id reachable by
    links), n_links_found (links found from its set to others;
    not all there are, as those that only join what is joined already aren't sought).
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    signed = table(batched(docs, partial(_digest, k=n, num=num, den=den, lower=lower), ", ".join(f"{x.name} {_SQL[x.type]}" for x in _SIGNED)), "signed")
    sets = table(signed.select(*_SETS.names), "sets")
    named = sets.where("n > 0 and doc_id is not null")
    # Copies hang on the first one of their task; only these meet, so no task gathers all copies of a text.
    leads = named.where("doc_id = lead").select("doc_id", "k1", "k2", "n").distinct()
    reps = leads.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"))
    same = leads.join(reps, ["k1", "k2", "n"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    same = same.union(named.select(F.col("lead").alias("a"), F.col("doc_id").alias("b"))).where("a <> b").distinct()

    # The signatures are the most there is on disk: they move a pass at a time, and go when all have met.
    shape, passes = "sig long, node long, n int, tag int, others long", []
    for g in range(PASSES):
        lists = signed.where(f"n > 0 and doc_id is not null and size(sigs{g}) > 0")
        lists = lists.select(F.explode(F.arrays_zip(F.col(f"sigs{g}").alias("sig"), F.col(f"tags{g}").alias("tag"))).alias("s"), F.col("n").cast("int"), F.col("doc_id").alias("node"))
        lists = lists.select("s.sig", "node", "n", "s.tag").repartition("sig").sortWithinPartitions("sig", "node")
        passes.append(table(batched(lists, _buckets, shape), "buckets"))
    free(signed)
    buckets = reduce(DataFrame.unionAll, passes)
    # Of a node's signatures by one cut, as many of the commonest as it can spare don't count.
    common = F.row_number().over(Window.partitionBy("node", "tag").orderBy(F.desc("others"), "sig"))
    met = F.sum("others").over(Window.partitionBy("node"))
    kept = buckets.withColumn("rank", common).where(F.col("rank") > F.floor(F.col("tag") / 2)).withColumn("meets", met)
    ranked = kept.select("sig", "node", "n", "meets").repartition("sig").sortWithinPartitions("sig", F.desc("meets"), "n", "node")
    stars = table(batched(ranked.select("sig", "node"), _stars, "hub long, node long").distinct(), "stars")
    free(*passes)
    held = table(compared(docs, stars, n, num, den, lower, True), "compared")
    edge = lambda x: x.select(F.col("hub").alias("a"), F.col("node").alias("b"))
    links = held.where("near").select("hub", "node")
    known = edge(links).union(same)
    comp = table(components(known), "components")

    far = held.where("not near").select("hub").distinct()
    placed = held.join(far, "hub").join(comp, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    # Of what is outside, a partner must share `least` at least, as it is no smaller than num / den of this one.
    placed = placed.withColumn("least", F.greatest(F.lit(1), F.ceil(F.col("n_node") * num / F.lit(den)) - F.col("common")))
    first_ones = F.slice("beside", F.lit(1), F.greatest(F.lit(0), F.col("n_node") - F.col("common") - F.col("least") + 1).cast("int"))
    beside = placed.select("hub", "node", "comp", "n_node", "common", "least", F.explode(first_ones).alias("gram")).withColumn("sig", F.xxhash64("hub", "gram")).drop("gram")
    beside = table(beside, "beside")
    meetings = _meetings(beside)
    met = batched(meetings.repartition("meet").sortWithinPartitions("meet", "comp"), partial(_across, num=num, den=den), "via long, hub long, node long, asked long")
    met = met.groupBy("via", "hub", "node").agg(F.count("*").alias("met"), F.max("asked").alias("asked"))
    pairs = met.where("met >= asked").select("hub", "node")
    # Enough in common within the hub's set: sizes up to `most`, met by size.
    most = F.floor(F.col("common") * (num + den) / F.lit(num)) - F.col("n_node")
    sized = placed.select("hub", "node", "comp", F.col("n_node").alias("size"), most.alias("most"))
    asking = placed.where("not near").select("hub", F.col("node").alias("x"), F.col("comp").alias("x_comp"), F.col("n_node").alias("x_size"), most.alias("x_most"))
    asking = asking.withColumn("low", F.ceil(F.col("x_size") * num / F.lit(den))).where("x_most >= low").withColumn("size", F.explode(F.sequence("low", F.least(F.col("x_most"), F.floor(F.col("x_size") * den / F.lit(num))))))
    inside = sized.join(asking, ["hub", "size"]).where("comp <> x_comp and most >= x_size").select(F.least("node", "x").alias("hub"), F.greatest("node", "x").alias("node"))
    pairs = pairs.unionByName(inside).distinct()
    pairs = table(pairs.join(stars, ["hub", "node"], "left_anti").join(stars.toDF("node", "hub"), ["hub", "node"], "left_anti"), "pairs")
    free(beside)
    if pairs.take(1):
        more = table(compared(docs, pairs, n, num, den, lower, False).where("near").select("hub", "node"), "links")
        if more.take(1):
            links = links.unionByName(more)
            comp = table(components(known.union(edge(more))), "components")

    each = edge(links).union(edge(links).select("b", "a")).groupBy(F.col("a").alias("rep_node")).agg(F.count("*").alias("n_links_found"))
    low = comp.select(F.col("node").alias("doc_id"), "component")
    rows = sets.select("doc_id", "n").join(low, "doc_id", "left").join(each.withColumnRenamed("rep_node", "doc_id"), "doc_id", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links_found", F.lit(0)).alias("n_links_found"))


def dedupe(docs: DataFrame, **how) -> DataFrame:
    """docs without near duplicates: of each component the row of the smallest doc_id stays.

    All columns stay as they are. Rows without words, or without doc_id, are linked with nothing and stay. Of rows
    that repeat one doc_id, all stay or all go.
    """
    found = ngram_join(docs, **how).where("doc_id <> component_id").select(F.col("doc_id").cast("long").alias("__gone")).distinct()
    return docs.join(found, docs["doc_id"].cast("long") == found["__gone"], "left_anti")

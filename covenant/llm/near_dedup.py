"""MinHash near-deduplication: documents whose sets of shingles are alike enough are one group.

1. A shingle is ``width`` words in a row. Documents of equal sets are a class; its smallest doc_id stands for it.
2. Many universal hash functions give each class a signature of minima. Bands of some minima (``banding``) are keys;
   classes that share a key are candidates. Within a key all are compared with its smallest member alone,
   by their signatures. Where some are far from it, those that aren't close to it meet again under the
   smallest of them. So candidates form groups without any list of pairs.
3. In a group everything is confirmed on full sets: first each member against the group's hub. What these
   links leave apart goes on only if it can still have a link: a member's shingles that no other member
   has, and those that it shares with the hub, bound every intersection. Two linked members of which one
   isn't linked with the hub must agree in some shingle by which both differ from the hub; pairs come from
   an index of such shingles, the rarest of each member (``_listed``), and are confirmed on full sets too. Where many
   share a shingle they are compared with the smallest of them first, and then only members of different parts meet.
4. Components of the confirmed links by alternating large-star and small-star.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covenant.llm.cluster import discard, lookup, materialised, prepare, tidy
from covenant.llm.components import components
from covenant.llm.words import Words, mix, rolling, slices, windows

#: A pair at the threshold shares no band once in ``MISS`` times at most. That takes 40 bands of 8 rows at 0.85, and 54 of 7 at 0.8.
MISS, MOST_BANDS, MOST_ROWS = 330_000, 54, 8
#: Signature similarity from which a member stays with a key's smallest, and below which it also meets the
#: others of its key again if some member doesn't stay. Their distance exceeds what two linked members can
#: differ by towards a third (1 - threshold), plus three standard errors of either estimate.
STAYS, MEETS_AGAIN = 0.45, 0.80
#: Pairs for each row of the index of differences from which members meet the smallest of a key before they meet each other.
CROWDED = 4
#: Rounds of meeting again; after them all that is left of a key joins its smallest member's group.
MEETINGS = 3

_SEEDS = np.random.Generator(np.random.PCG64(20_240_001))
_FACTORS, _SHIFTS = zip(*((_SEEDS.integers(0, 1 << 31, n, dtype=np.uint64), _SEEDS.integers(0, 1 << 32, n, dtype=np.uint64)) for n in (320, 112)), strict=True)
_A, _B = (np.concatenate(_FACTORS) * 2 + 1).astype(np.uint32), np.concatenate(_SHIFTS).astype(np.uint32)


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows for a threshold: as many rows to a band as ``MOST_BANDS`` allow. Below 21 percent pairs are missed more often than ``MISS`` says."""
    for rows in range(MOST_ROWS, 0, -1):
        share = min(percent / 100, 0.999) ** rows
        bands = int(np.ceil(np.log(MISS) / -np.log1p(-share)))
        if bands <= MOST_BANDS:
            return bands, rows
    return MOST_BANDS, 1


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each row's shingles, and where each row's hashes start.

    Letters A-Z are lowered. A text of fewer than ``width`` words has its whole sequence as one shingle,
    which equals no shingle of another length. A text without words has none.
    """
    words = Words(texts, lower=True)
    at, rows = windows(words.starts, width)
    h = words.vocab_hashes()[words.codes]
    found, owner = rolling(h, at, width) if len(at) else np.zeros(0, np.uint64), rows
    n = words.counts
    for k in range(1, width):
        few = np.nonzero(n == k)[0]
        if len(few):
            whole = rolling(h, words.starts[:-1][few], k)
            found, owner = np.concatenate((found, mix(whole + np.uint64(k)))), np.concatenate((owner, few))
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], np.searchsorted(owner[new], np.arange(len(words) + 1))


def signatures(hashes: np.ndarray, starts: np.ndarray, minima: int, step: int = 1 << 16) -> np.ndarray:
    """Rows x ``minima`` minima of a * x + b modulo 2**32 over each row's hashes; rows without hashes have zeros."""
    n = len(starts) - 1
    out = np.zeros((minima, n), np.uint32)
    x = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    full = np.nonzero(np.diff(starts))[0]
    first = 0
    with np.errstate(over="ignore"):
        while first < len(full):  # stretches that fit into the processor's cache
            last = max(first + 1, int(np.searchsorted(starts[full + 1], starts[full[first]] + step, side="right")))
            rows = full[first:last]
            part, cuts = x[starts[rows[0]] : starts[rows[-1] + 1]], starts[rows] - starts[rows[0]]
            held = np.empty_like(part)
            for j in range(minima):
                np.multiply(part, _A[j], out=held)
                np.add(held, _B[j], out=held)
                out[j, rows] = np.minimum.reduceat(held, cuts)
            first = last
    return np.ascontiguousarray(out.T)


SIGNED = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("keys", pa.list_(pa.int64())), ("bits", pa.binary())])


def sign(texts: DataFrame, width: int, bands: int, per_band: int) -> DataFrame:
    """(doc_id, mark, n_shingles, set_a, set_b, keys, bits) of ``texts(doc_id, text, mark)``: a 128-bit hash of the set, the bands' keys, a byte of each minimum."""

    def run(batches):
        with np.errstate(over="ignore"):
            base = np.uint64(0x100000001B3) ** np.arange(per_band, dtype=np.uint64)
            for batch in slices(batches, 1 << 20):
                hashes, starts = shingles(batch.column(1), width)
                n = np.diff(starts)
                total = np.zeros((2, len(hashes) + 1), np.uint64)
                np.cumsum(mix(hashes), out=total[0, 1:])
                np.cumsum(mix(hashes ^ np.uint64(0x9E3779B97F4A7C15)), out=total[1, 1:])
                whole = (total[:, starts[1:]] - total[:, starts[:-1]]).view(np.int64)
                minima = signatures(hashes, starts, bands * per_band)
                keys = mix((mix(minima.astype(np.uint64).reshape(len(n), bands, per_band)) * base).sum(2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands), pa.array(keys.view(np.int64).ravel()))
                low = (minima >> np.uint32(24)).astype(np.uint8) ^ (minima >> np.uint32(8)).astype(np.uint8) ^ minima.astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(whole[0]), pa.array(whole[1]), listed, pa.array([r.tobytes() for r in low], pa.binary())], schema=SIGNED)

    return texts.mapInArrow(tidy(run), "doc_id long, mark long, n_shingles long, set_a long, set_b long, keys array<long>, bits binary")


def similar(pairs: DataFrame) -> DataFrame:
    """``pairs(key..., u_bits, v_bits)`` with the bytes replaced by ``estimate``: the similarity by the share of equal bytes, less what chance makes equal."""
    rest = [c for c in pairs.columns if c not in ("u_bits", "v_bits")]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                u, v = (np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("u_bits", "v_bits"))
                share = (u == v).mean(1)
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in rest), pa.array((share - 1 / 256) / (1 - 1 / 256))], names=[*rest, "estimate"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return pairs.mapInArrow(tidy(run), StructType([*(pairs.schema[c] for c in rest), StructField("estimate", DoubleType())]))


def candidate_links(reps: DataFrame, bands: int) -> DataFrame:
    """(u, v) links that join all candidates of ``reps(rep, keys, bits)`` into groups."""
    bits = reps.select("rep", "bits")
    members, total = reps.select(F.explode("keys").alias("key"), "rep"), bands * reps.count()
    found, written = None, []
    for meeting in range(MEETINGS + 1):
        hubs = members.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("held")).where("held > 1")
        joined, hubs = lookup(members, hubs, "key", total)
        met = materialised(joined.where("rep <> hub"), "met")
        discard(hubs)
        pairs = met.select("hub", "rep").distinct()
        if meeting < MEETINGS:
            sized = pairs.join(bits.select("rep", F.col("bits").alias("v_bits")), "rep").join(bits.select(F.col("rep").alias("hub"), F.col("bits").alias("u_bits")), "hub")
            judged = materialised(similar(sized), "judged")
            written.append(judged)
            links = judged.where(F.col("estimate") >= STAYS).select(F.col("hub").alias("u"), F.col("rep").alias("v"))
        else:
            links = pairs.select(F.col("hub").alias("u"), F.col("rep").alias("v"))
        found = links if found is None else found.unionAll(links)
        if meeting == MEETINGS or not judged.where(F.col("estimate") < STAYS).limit(1).count():
            found = materialised(found.distinct(), "candidates")
            discard(*written, met)
            return found
        split = met.join(judged, ["hub", "rep"])
        open_keys = split.where(F.col("estimate") < STAYS).select("key").distinct()
        members = materialised(split.where(F.col("estimate") < MEETS_AGAIN).join(open_keys, "key", "left_semi").select("key", "rep"), "members")
        discard(met)
        written.append(members)
        total = members.count()
    raise AssertionError


COMPARED = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n_u", pa.int64()), ("n_v", pa.int64()), ("common", pa.int64()), ("only_v", pa.list_(pa.int64())), ("only_u", pa.list_(pa.int64()))])


def compare(pairs: DataFrame, texts: DataFrame, width: int, extra: bool) -> DataFrame:
    """(u, v, n_u, n_v, common, only_v, only_u) for each of ``pairs(u, v)`` by full sets of ``texts(rep, text)``.

    ``only_v`` has v's shingle hashes that u lacks if ``extra``, else null; ``only_u`` the other way round. A
    text of u that follows itself is cut into shingles once for all its rows in a batch.
    """

    def run(batches):
        for batch in slices(slices(batches, 2 << 20, "u_text"), 2 << 20, "v_text"):
            u = batch.column(0).to_numpy()
            text = pc.fill_null(batch.column(2), "")
            other = pc.not_equal(text.slice(1), text.slice(0, len(text) - 1)).to_numpy(zero_copy_only=False)
            lead = np.concatenate(([True], (u[1:] != u[:-1]) | other))
            of = np.cumsum(lead) - 1
            once = batch.column(2).take(pa.array(np.nonzero(lead)[0]))
            hashes, starts = shingles(pa.concat_arrays([once, batch.column(3)]), width)
            base, rows = int(lead.sum()), batch.num_rows
            n = np.diff(starts)
            common, only, lost = np.zeros(rows, np.int64), [], []
            for k in range(base):  # all rows of one text of u at a time
                a, b = np.searchsorted(of, [k, k + 1])
                mine = hashes[starts[k] : starts[k + 1]]
                theirs, cuts = hashes[starts[base + a] : starts[base + b]], starts[base + a : base + b + 1] - starts[base + a]
                at = np.minimum(np.searchsorted(mine, theirs), max(len(mine) - 1, 0))
                same = mine[at] == theirs if len(mine) else np.zeros(len(theirs), bool)
                total = np.concatenate(([0], np.cumsum(same)))
                common[a:b] = total[cuts[1:]] - total[cuts[:-1]]
                if extra:
                    left, gone = theirs[~same].view(np.int64), cuts - total[cuts]
                    only += [left[x:y] for x, y in zip(gone.tolist(), gone[1:].tolist(), strict=False)]
                    for x, y in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                        lacks = np.ones(len(mine), bool)
                        lacks[at[x:y][same[x:y]]] = False
                        lost.append(mine[lacks].view(np.int64))
            arrays = [pa.array(a if extra else [None] * rows, pa.list_(pa.int64())) for a in (only, lost)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n[of]), pa.array(n[base:]), pa.array(common), *arrays], schema=COMPARED)

    first = pairs.join(texts.select(F.col("rep").alias("v"), F.col("text").alias("v_text")), "v")
    both = first.join(texts.select(F.col("rep").alias("u"), F.col("text").alias("u_text")), "u").select("u", "v", "u_text", "v_text")
    return both.mapInArrow(tidy(run), "u long, v long, n_u long, n_v long, common long, only_v array<long>, only_u array<long>")


def _alike(n_u: str, n_v: str, common: Column, percent: int) -> Column:
    """100 * common >= percent * union, in whole numbers."""
    return (100 + percent) * common >= percent * (F.col(n_u) + F.col(n_v))


def _listed(alive: DataFrame, differences: DataFrame, percent: int) -> DataFrame:
    """Members of ``alive(hub, n_hub, node, mark, n, common, others, linked)``, a row for each shingle h by which they can meet a partner.

    Only pairs that have a (hub, h) in common can be linked, as far as x isn't linked with its hub. ``mark`` tells apart rows of one doc_id with several texts. By the differences D to the hub, (hub, node,
    mark, h), x and y differ in |Dx| + |Dy| - 2 |Dx and Dy| shingles, and
    linked ones in k (n_x + n_y) at most, k = (100 - percent) / (100 + percent). As x isn't linked with the
    hub, |Dx| > k (n_x + n_hub), so x and y agree in at least one element, and in the more the larger Dx and Dy
    are. With a member's elements from the rarest in the group on, two that agree in c of them share one of
    their first |D| - c + 1: only these are joined.
    """
    own, away, n, hub = (100 + percent), (100 - percent), F.col("n"), F.col("n_hub")
    size = n + hub - 2 * F.col("common")
    # The least agreement with any partner: of an unlinked member by the partner's size that asks for least, of a linked one by its partner's distance from the hub.
    partner = F.least(F.greatest(hub.cast("double"), n * percent / 100), n * 100 / F.lit(percent))
    apart = F.ceil((own * (size + F.abs(partner - hub)) - away * (n + partner)) / (2 * own) - 1e-6)
    near = F.floor((own * size + away * (hub - n)) / (2 * own) - 1e-6) + 1
    agree = F.greatest(F.lit(1), F.when(F.col("linked"), near).otherwise(apart))
    members = alive.withColumn("first", size - agree + 1)
    listed = members.join(differences, ["hub", "node", "mark"])
    often = listed.groupBy("hub", "h").agg(F.count("*").alias("often"))
    placed = listed.join(often, ["hub", "h"]).withColumn("place", F.row_number().over(Window.partitionBy("hub", "node", "mark").orderBy("often", "h")))
    return placed.where("place <= first and often > 1").select("hub", "h", "node", "n", "common", "others", "linked")


def _meet(listed: DataFrame, percent: int) -> DataFrame:
    """(u, v) pairs of ``_listed``' members with a ``part`` that meet, x not linked with its hub, and aren't of one part."""
    x = listed.where("not linked").select("hub", "h", *(F.col(c).alias(f"x_{c}") for c in ("node", "n", "common", "others", "part")))
    y = listed.select("hub", "h", *(F.col(c).alias(f"y_{c}") for c in ("node", "n", "common", "others", "linked", "part")))
    most = F.least("x_common", "y_common") + F.least("x_others", "y_others")
    met = x.join(y, ["hub", "h"]).where(
        (F.col("y_linked") | (F.col("y_node") > F.col("x_node"))) & (F.col("x_part") != F.col("y_part")) & _alike("x_n", "y_n", F.least(most, F.col("x_n"), F.col("y_n")), percent)
    )
    return met.select(F.col("x_node").alias("u"), F.col("y_node").alias("v")).distinct()


def _settled(listed: DataFrame, linked: DataFrame, texts: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (u, v) of members with the smallest of those whom they can meet by a shingle, and (node, part) by these and by ``linked(u, v)``.

    A branch of a group, however large, whose members are alike has one part then, and its members needn't meet each other.
    """
    least = materialised(listed.groupBy("hub", "h").agg(F.min("node").alias("least")), "least")
    pairs = listed.join(least, ["hub", "h"]).where("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v")).distinct()
    alike = compare(pairs, texts, width, extra=False).where(_alike("n_u", "n_v", F.col("common"), percent))
    links = materialised(alike.select("u", "v").distinct(), "settled")
    discard(least)
    parts = components(links.unionAll(linked))
    return links, parts.select("node", F.col("root").alias("part"))


def confirmed_links(links: DataFrame, reps: DataFrame, texts: DataFrame, width: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """(u, v) for enough pairs of alike classes that each has its whole component, and the tables that they are read from."""
    grouped = components(links)
    members = grouped.unionAll(grouped.select(F.col("root").alias("node"), "root").distinct())
    weighed = members.join(reps.select(F.col("rep").alias("node"), "copies"), "node")
    hubs = weighed.groupBy("root").agg(F.max_by("node", F.struct("copies", -F.col("node"))).alias("hub"), F.count("*").alias("held"))
    joined, hubs = lookup(weighed, hubs, "root", 2 * reps.count())
    pairs = joined.where("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v"))
    wanted = texts.join(members.select(F.col("node").alias("rep")), "rep", "left_semi")
    wanted = materialised(wanted, "group-texts")
    tried = materialised(compare(pairs, wanted, width, extra=True), "tried")
    alike = _alike("n_u", "n_v", F.col("common"), percent)
    good = tried.where(alike)

    # Members of groups that aren't whole yet: shingles beyond the hub's, and how many of them another member has too.
    marked = tried.withColumn("mark", F.xxhash64("n_u", "only_v", "only_u"))
    unfinished = tried.groupBy("u").agg(F.count("*").alias("held"), F.every(alike).alias("whole")).where("not whole").drop("whole")
    unfinished, unwhole = lookup(marked, unfinished, "u", tried.count())
    beyond = unfinished.select("u", "v", F.explode("only_v").alias("h"))
    shared = beyond.groupBy("u", "h").agg(F.count("*").alias("n")).where("n > 1").select("u", "h")
    with_others = beyond.join(shared, ["u", "h"]).groupBy("u", "v").agg(F.count("*").alias("others"))
    bound = unfinished.drop("only_v", "only_u").join(with_others, ["u", "v"], "left").na.fill(0, ["others"]).withColumn("linked", _alike("n_u", "n_v", F.col("common"), percent))
    bound = materialised(bound.select(F.col("u").alias("hub"), F.col("n_u").alias("n_hub"), F.col("v").alias("node"), "mark", F.col("n_v").alias("n"), "common", "others", "linked"), "bounds")
    # Alone, a member can't reach more than its own shingles that the hub or another member has.
    alive = bound.where(100 * (F.col("common") + F.col("others")) >= percent * F.col("n"))
    still = alive.groupBy("hub").agg(F.count("*").alias("held"), F.every("linked").alias("whole")).where("not whole").drop("whole")
    alive, still = lookup(alive, still, "hub", bound.count())
    differences = marked.select(F.col("u").alias("hub"), F.col("v").alias("node"), "mark", F.explode(F.concat("only_v", "only_u")).alias("h"))
    listed = materialised(_listed(alive, differences, percent), "listed")
    found, read = good.select("u", "v"), [grouped, hubs, wanted, tried, unwhole, bound, still, listed]
    keys = listed.groupBy("hub", "h").agg(F.count("*").alias("all"), F.count_if(~F.col("linked")).alias("loose"))
    rows, pairs = keys.agg(F.coalesce(F.sum("all"), F.lit(0)), F.coalesce(F.sum(F.col("all").cast("double") * F.col("loose")), F.lit(0.0))).first()
    apart = listed.withColumn("part", F.col("node"))
    if pairs > CROWDED * rows:  # members would meet each other too often: first they meet the smallest of them
        links, parts = _settled(listed, bound.where("linked").select(F.col("hub").alias("u"), F.col("node").alias("v")), wanted, width, percent)
        apart = listed.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
        found, read = found.unionAll(links), [*read, links]
    late = compare(_meet(apart, percent), wanted, width, extra=False).where(_alike("n_u", "n_v", F.col("common"), percent))
    return found.unionAll(late.select("u", "v")), read


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """A row for each document of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * common shingles >= ``percent`` * shingles of either; a component
    is named by its smallest doc_id, and that document is kept. A text of fewer than ``width`` words is one
    shingle; one without words (or null) has none and is a component by itself. Rows that repeat a doc_id
    are one node, and all of them are marked as kept or not. Rows with a null doc_id get the component of their
    equals in set if these have an id, else null; they are kept only in the latter case.
    """
    return _marked(docs, width, percent).drop("mark")


def _marked(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``near_duplicates`` with ``mark``, a hash of each row's text, behind the doc_id."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialised(sign(texts.withColumn("mark", F.xxhash64("text")), width, *banding(percent)), "signed")
    sets = ["set_a", "set_b", "n_shingles"]
    classes = signed.where("n_shingles > 0").groupBy(*sets).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = materialised(classes, "classes")
    named = classes.where("rep is not null")
    chosen = signed.join(named.withColumnRenamed("rep", "doc_id"), ["doc_id", *sets])
    reps = materialised(chosen.dropDuplicates(["doc_id", *sets]).select(F.col("doc_id").alias("rep"), "keys", "bits", "copies"), "reps")
    candidates = candidate_links(reps, banding(percent)[0])
    links, read = confirmed_links(candidates, reps, texts.withColumnRenamed("doc_id", "rep"), width, percent)
    rooted = components(links)
    discard(candidates, reps, *read)
    roots = named.join(rooted, named["rep"] == rooted["node"], "left").select(*sets, F.coalesce("root", "rep").alias("root"))
    out = signed.select("doc_id", "mark", *sets).join(roots, sets, "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "mark", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs``, all columns, of each document that ``near_duplicates`` keeps.

    Rows that repeat a doc_id are one document, of which one row stays. A row with a null doc_id stays only
    where no row with an id has its set, and of those of equal text one stays. An empty table stays empty, and
    columns of any name but ``doc_id`` and ``text`` pass through.
    """
    kept = _marked(docs, width, percent).where("kept").groupBy("doc_id", "mark").agg(F.count("*").alias("rows"))
    chosen = kept.groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("mark"))).agg(F.min(F.struct("mark", "rows")).alias("x"))
    chosen = chosen.select(F.col("doc_id").alias("__id"), F.col("x.mark").alias("__mark"), F.col("x.rows").alias("__rows"))
    found = docs.join(chosen, docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__mark")))
    return found.where("__rows = 1").unionAll(found.where("__rows > 1").dropDuplicates(["__id", "__mark"])).select(*docs.columns)

"""One batch of the assembly: the pool and its links before, the pool, links and mask after.

State is four tables: sequences, links, the length histogram, and the mask. ``Aligner`` is where another aligner plugs in.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alignment as al
from ..functions import dna
from ..operators import benefit as be
from ..operators import coverage as co
from ..operators import links as li
from ..operators import overlap as ov
from ..operators import pool as po
from ..operators import unitigs as un
from .storage import materialize

SEQUENCES = "header string, seq string, cov array<double>, atoms array<string>, components array<string>, temperature int, cap_l boolean, cap_r boolean, acceptor boolean"
LINKS = "u string, v string, qname string, qlen long, qstart long, qend long, tname string, tlen long, tstart long, tend long, rev int, s1 long, qside string, tside string, line_no long"
LINK_COLUMNS = [c.split()[0] for c in LINKS.split(", ")]


@dataclass(frozen=True)
class Settings:
    min_seq_len: int = 2500
    min_contig_len: int = 10_000
    min_s1: int = 200
    min_map_len: int = 2000
    temperature: int = po.REHEATED
    mu: int = 400
    lowcov: float = 10
    tetra: bool = True
    filter_repeats: bool = False


@dataclass(frozen=True)
class Aligner:
    """Takes (new, pool) sequences as (id, seq), pool may be None, and returns alignment records."""

    overlaps: Callable[[DataFrame, DataFrame | None], DataFrame] = lambda new, pool: ov.all_against_all(new) if pool is None else ov.incremental(new, pool)


@dataclass(frozen=True)
class State:
    sequences: DataFrame
    links: DataFrame
    lengths: DataFrame
    mask: DataFrame | None = None
    batch: int = 0


def empty(spark: SparkSession) -> State:
    return State(spark.createDataFrame([], SEQUENCES), spark.createDataFrame([], LINKS), spark.createDataFrame([], "length long, n long"))


def _named(sequences: DataFrame) -> DataFrame:
    return sequences.select(F.col("header").alias("id"), "seq")


@dataclass(frozen=True)
class Loaded:
    sequences: DataFrame
    links: DataFrame
    trims: DataFrame
    overlaps: DataFrame


def load(state: State, records: DataFrame, settings: Settings, reheat_to: int, propagate: bool = True, settle: bool = True) -> Loaded:
    """Takes alignment records into the pool: containments hand on coverage and leave, overlaps become links.

    Without ``settle`` only links and what follows from the records are taken; no sequence leaves, gains coverage or is reheated.
    """
    numbered = materialize(records.withColumn("line_no", F.monotonically_increasing_id()), "records")
    found = al.with_class(numbered.filter(al.passes(settings.min_map_len, settings.min_s1, settings.min_seq_len)))
    if settings.tetra:
        near = dna.intra_pairs(found.filter("c in (4, 5)").select("qname", "tname").distinct(), state.sequences).select("qname", "tname")
        found = found.filter("c not in (4, 5)").unionByName(found.filter("c in (4, 5)").join(near, ["qname", "tname"], "left_semi"))
    closed = state.sequences.filter("not acceptor").select("header")
    found = materialize(li.with_acceptors(found, closed), "classified")
    edges = li.containments(found).withColumn("x", al.containment_coordinates()).select("source", "target", "x.cstart", "x.cend", "x.ostart", "x.oend", "rev")
    sources = edges.select(F.col("source").alias("header")).distinct()
    several = li.multiline_containments(found.filter("c = 1"), sources).select("source", "target", "cstart", "cend", "ostart", "oend", F.lit(0).alias("rev"))
    edges = materialize(edges.join(several.select("source", "target"), ["source", "target"], "left_anti").unionByName(several), "edges")
    linked = li.links(found, state.links).select(*LINK_COLUMNS)
    if not settle:
        return Loaded(state.sequences, materialize(linked, "links"), found.filter("c = 6"), li.last_overlaps(found))
    sequences = co.propagate(state.sequences, edges) if propagate and not edges.isEmpty() else state.sequences
    contained = edges.select(F.col("source").alias("header")).distinct()
    hot = li.overlappers(li.links(found))
    sequences = po.reheat(po.without(sequences, contained), hot, reheat_to)
    return Loaded(materialize(sequences, "sequences"), materialize(li.without_sequences(linked, contained), "links"), found.filter("c = 6"), li.last_overlaps(found))


def add(state: State, new: DataFrame, settings: Settings, aligner: Aligner, propagate: bool = True) -> tuple[State, Loaded]:
    """New sequences meet each other and the pool, whose own pairs were met before."""
    fresh = materialize(new, "new")
    records = aligner.overlaps(_named(fresh), _named(state.sequences))
    held = replace(state, sequences=materialize(po.upsert(state.sequences, fresh), "sequences"))
    done = load(held, records, settings, settings.temperature, propagate)
    return replace(held, sequences=done.sequences, links=done.links), done


def overlap_contigs(state: State, settings: Settings, aligner: Aligner) -> tuple[State, Loaded | None]:
    contigs = po.contigs(state.sequences, settings.min_contig_len)
    if contigs.isEmpty():
        return state, None
    done = load(state, aligner.overlaps(_named(contigs), None), settings, po.REHEATED_CONTIG)
    return replace(state, sequences=done.sequences, links=done.links), done


def retry_trimmed(state: State, last: Loaded, settings: Settings, aligner: Aligner) -> State:
    """Internal matches that a cut would turn into overlaps are cut and aligned again; whichever copy has no use goes."""
    coords = last.trims.select(al.trim_coordinates().alias("x")).select("x.*").filter("sid <> '0'")
    # Of several cuts of a sequence one is tried.
    cuts = materialize(li.latest_best(coords, ["sid"], "new_len", "trim_start", "other"), "cuts")
    if cuts.isEmpty():
        return state
    copies = co.trim(state.sequences.select("header", "seq", "cov"), cuts.select("sid", "trim_start", "trim_stop"))
    rest = state.sequences.select(F.concat("header", F.lit("%")).alias("header"), "atoms", "components", "temperature", "cap_l", "cap_r", "acceptor")
    copies = materialize(copies.join(rest, "header").select(*state.sequences.columns), "copies")
    partners = state.sequences.join(cuts.select(F.col("other").alias("header")).distinct(), "header", "left_semi")
    held = replace(state, sequences=materialize(po.upsert(state.sequences, copies), "sequences"))
    done = load(held, aligner.overlaps(_named(copies), _named(partners)), settings, settings.temperature, settle=False)
    gone = materialize(li.trim_outcome(cuts.select("sid"), done.overlaps), "gone")
    return replace(held, sequences=materialize(po.without(done.sequences, gone), "sequences"), links=materialize(li.without_sequences(done.links, gone), "links"))


def assemble(state: State, settings: Settings, aligner: Aligner) -> State:
    """Paths of linked sequences become unitigs that take their place, with their coverage, atoms and components."""
    lengths = state.sequences.select("header", F.length("seq").cast("long").alias("length"))
    if state.links.isEmpty():
        return state
    placed = materialize(un.layout(state.links.filter("u < v"), lengths), "layout")
    if placed.isEmpty():
        return state
    whole = un.assembled(placed, state.sequences)
    sized = placed.join(whole.select("unitig", "length"), "unitig")
    cov = co.merge_layout(sized, state.sequences)
    inside = po.members(placed.select("unitig", F.col("name").alias("header")), state.sequences)
    new = whole.join(cov, "unitig").join(inside, "unitig").select(
        F.concat(un.stable_id(F.col("components")), F.when(F.col("circ"), "c").otherwise("")).alias("header"), "seq", "cov", "atoms", "components",
        F.lit(po.START_TEMPERATURE).alias("temperature"), F.lit(False).alias("cap_l"), F.lit(False).alias("cap_r"), (~F.col("circ")).alias("acceptor"),
    )
    new = materialize(new.filter(F.length("seq") > settings.min_seq_len), "unitigs")
    used = placed.select(F.col("name").alias("header")).distinct()
    held = replace(state, sequences=materialize(po.without(state.sequences, used), "sequences"), links=materialize(li.without_sequences(state.links, used), "links"))
    return add(held, new, settings, aligner, propagate=False)[0]


def freeze(state: State, settings: Settings) -> State:
    cooled = po.cool(state.sequences, settings.min_contig_len)
    frozen = cooled.filter("frozen").select("header")
    return replace(state, sequences=materialize(cooled.filter("not frozen").drop("frozen"), "sequences"), links=materialize(li.without_sequences(state.links, frozen), "links"))


def decide(state: State, settings: Settings) -> DataFrame | None:
    """The mask of the pool's contigs; none before there are contigs and enough read lengths."""
    contigs = po.contigs(state.sequences, settings.min_contig_len)
    if contigs.isEmpty():
        return None
    pieces = [r["width"] // 100 for r in be.length_pieces(state.lengths).orderBy("piece").collect()]
    lam = be.mean_length(state.lengths).first()["lam"]
    # Without reads of a usable length the prior's pieces do.
    if len(pieces) < be.PIECES or min(pieces) < 1:
        pieces, lam = prior_pieces(), 6000.0
    bins = be.chunk(contigs.select(F.col("header").alias("contig"), "cov"))
    caps = contigs.select(F.col("header").alias("contig"), "cap_l", "cap_r")
    return materialize(be.strategy(bins, pieces, lam, settings.mu, settings.lowcov, caps), "mask")


def prior_pieces(lam: float = 6000, sd: float = 4000, n: int = 46_000) -> list[int]:
    import numpy as np

    x = np.arange(n)
    share = np.exp(-((x - lam + 1) ** 2) / (2 * sd * sd))
    sums = np.cumsum(share / share.sum())
    return [int(np.argmax(sums >= (k + 0.5) / be.PIECES)) // 100 for k in range(be.PIECES)]


def update(state: State, reads: DataFrame, settings: Settings | None = None, aligner: Aligner | None = None) -> State:
    """The state after a batch of ``reads(read_id, seq)``."""
    settings, aligner = settings or Settings(), aligner or Aligner()
    lengths = materialize(be.length_histogram(reads.select(F.length("seq").alias("length")), state.lengths, settings.mu), "lengths")
    if settings.filter_repeats:
        reads = without_repeats(reads, aligner)
    state, done = add(replace(state, lengths=lengths), po.intake(reads, settings.min_seq_len), settings, aligner)
    state, contig_load = overlap_contigs(state, settings, aligner)
    state = retry_trimmed(state, contig_load or done, settings, aligner)
    state = assemble(state, settings, aligner)
    state = freeze(state, settings)
    return replace(state, mask=decide(state, settings), batch=state.batch + 1)


def without_repeats(reads: DataFrame, aligner: Aligner) -> DataFrame:
    """Reads with repeats at their ends, as found by the batch's own alignments, go."""
    records = materialize(aligner.overlaps(reads.select(F.col("read_id").alias("id"), "seq"), None), "records")
    sides = records.select(F.explode(F.array(F.struct(F.col("tname").alias("target"), F.col("tlen").alias("tlen"), F.col("tstart").alias("tstart"), F.col("tend").alias("tend")), F.struct(F.col("qname").alias("target"), F.col("qlen").alias("tlen"), F.col("qstart").alias("tstart"), F.col("qend").alias("tend")))).alias("x")).select("x.*")
    depth = co.depth(sides)
    limit = co.depth_limit(depth).first()
    if limit is None or limit["limit"] is None:
        return reads
    sites = co.islands(depth, limit["limit"])
    return co.without_end_repeats(reads, sites.select("target", F.col("start").alias("tstart"), F.col("end").alias("tend")))

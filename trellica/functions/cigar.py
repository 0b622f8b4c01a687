"""Operation strings as Spark expressions: parsing, statistics, coordinates, aligned strings and re-scoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trellica.functions.scoring import Scoring


def valid(cigar: Column) -> Column:
    """True for a (possibly empty) sequence of positive counts with an operation each."""
    return cigar.rlike(r"^([1-9][0-9]*[=XDI])*$")


def run_list(cigar: Column) -> Column:
    """array<struct<op, n, q, t>>: each run with its offset in query and target from the path's start."""
    parts = F.regexp_extract_all(cigar, F.lit(r"([0-9]+[=XDI])"), F.lit(1))
    made = F.transform(parts, lambda p: F.struct(F.substring(p, -1, 1).alias("op"), F.rtrim(p, F.lit("=XDI")).cast("int").alias("n")))
    kind = "array<struct<op:string,n:int,q:int,t:int>>"
    zero = F.struct(F.lit(0).alias("q"), F.lit(0).alias("t"), F.array().cast(kind).alias("out"))

    def step(acc: Column, r: Column) -> Column:
        both = F.array(F.struct(r["op"].alias("op"), r["n"].alias("n"), acc["q"].alias("q"), acc["t"].alias("t")))
        return F.struct((acc["q"] + F.when(r["op"] == "I", 0).otherwise(r["n"])).alias("q"), (acc["t"] + F.when(r["op"] == "D", 0).otherwise(r["n"])).alias("t"), F.concat(acc["out"], both).alias("out"))

    return F.aggregate(made, zero, step, lambda acc: acc["out"])


def total(cigar: Column, ops: str) -> Column:
    """Length of all runs of the given operations."""
    found = F.regexp_extract_all(cigar, F.lit(rf"([0-9]+)[{ops}]"), F.lit(1))
    return F.aggregate(found, F.lit(0).cast("long"), lambda acc, n: acc + n.cast("long"))


def stats(cigar: Column) -> Column:
    """struct<matches, block_len, edit_ops>."""
    return F.struct(total(cigar, "=").alias("matches"), total(cigar, "=XDI").alias("block_len"), total(cigar, "XDI").alias("edit_ops"))


NAMES = {"=": "match", "X": "mismatch", "D": "delete", "I": "insert"}


def op_name(op: Column) -> Column:
    out = F.lit(None).cast("string")
    for symbol, name in NAMES.items():
        out = F.when(op == symbol, name).otherwise(out)
    return out


def operation_counts(cigar: Column) -> Column:
    """array<struct<op, count>> in order of first appearance."""
    kinds = F.array_distinct(F.regexp_extract_all(cigar, F.lit(r"([=XDI])"), F.lit(1)))
    each = F.create_map(*[x for op in NAMES for x in (F.lit(op), total(cigar, op))])
    return F.transform(kinds, lambda op: F.struct(op_name(op).alias("op"), F.element_at(each, op).alias("count")))


def operations(cigar: Column, query: Column, target: Column, query_start: Column, target_start: Column) -> Column:
    """array<struct<op, query_pos, target_pos, query_base, target_base>> in input coordinates; a side that a step leaves out is null."""

    def placed(r: Column) -> Column:
        return F.struct(op_name(r["op"]).alias("op"), r["n"].alias("n"), F.when(r["op"] != "I", query_start + r["q"]).alias("q"), F.when(r["op"] != "D", target_start + r["t"]).alias("t"))

    def spread(r: Column) -> Column:
        def one(k: Column) -> Column:
            q, t = r["q"] + k, r["t"] + k
            return F.struct(r["op"].alias("op"), q.alias("query_pos"), t.alias("target_pos"), F.substring(query, q + 1, F.lit(1)).alias("query_base"), F.substring(target, t + 1, F.lit(1)).alias("target_base"))

        return F.transform(F.sequence(F.lit(0), r["n"] - 1), one)

    return F.flatten(F.transform(F.transform(run_list(cigar), placed), spread))


def common_subsequence(cigar: Column, query: Column, query_start: Column) -> Column:
    """The symbols that a path matches, in order: a longest common subsequence for a path of mode lcs."""
    return F.array_join(F.transform(F.filter(run_list(cigar), lambda r: r["op"] == "="), lambda r: F.substring(query, query_start + r["q"] + 1, r["n"])), "")


def aligned(cigar: Column, sequence: Column, start: Column, gap_op: str) -> Column:
    """The sequence with - where the other side has a symbol of its own; gap_op is I for the query, D for the target."""
    offset = "q" if gap_op == "I" else "t"
    return F.array_join(F.transform(run_list(cigar), lambda r: F.when(r["op"] == gap_op, F.repeat(F.lit("-"), r["n"])).otherwise(F.substring(sequence, start + r[offset] + 1, r["n"]))), "")


def rescore(cigar: Column, query: Column, target: Column, span: list[Column], scoring: Scoring, affine: bool = False) -> Column:
    """Score of a path from its runs and the symbols they pair, independent of the kernel.

    span: start and end in the query, start and end in the target. Null if the runs do not fill the span, or if = or X
    contradict the symbols. No symbol stands for a gap, so sequences may hold any, - included.
    """
    runs = run_list(cigar)
    query_piece = lambda r: F.substring(query, span[0] + r["q"] + 1, r["n"])
    target_piece = lambda r: F.substring(target, span[2] + r["t"] + 1, r["n"])
    paired = lambda r, f: F.zip_with(F.split(query_piece(r), ""), F.split(target_piece(r), ""), f)
    agrees = lambda r: F.when(r["op"] == "=", query_piece(r) == target_piece(r)).when(r["op"] == "X", F.forall(paired(r, lambda a, b: ~a.eqNullSafe(b)), lambda x: x)).otherwise(True)
    fills = (total(cigar, "=XD") == span[1] - span[0]) & (total(cigar, "=XI") == span[3] - span[2]) & (span[1] <= F.length(query)) & (span[3] <= F.length(target))
    if scoring.matrix is None:
        pairs = total(cigar, "=") * scoring.match - total(cigar, "X") * scoring.mismatch
    else:
        m = scoring.matrix
        flat = F.array(*[F.lit(v) for row in m.rows for v in row])
        place = lambda c: F.instr(F.lit(m.alphabet.upper()), F.upper(c)) - 1
        both = F.filter(runs, lambda r: r["op"].isin("=", "X"))
        scores = F.flatten(F.transform(both, lambda r: paired(r, lambda a, b: F.get(flat, place(a) * len(m.alphabet) + place(b)))))
        pairs = F.aggregate(scores, F.lit(0).cast("long"), lambda acc, x: acc + x)
    gaps = total(cigar, "DI")
    opened = F.size(F.regexp_extract_all(cigar, F.lit(r"([DI])"), F.lit(1)))
    cost = opened * scoring.gap_open + gaps * scoring.gap_extend if affine else gaps * scoring.gap
    return F.when(valid(cigar) & fills & F.forall(runs, agrees), pairs + cost)


def swap_gaps(cigar: Column) -> Column:
    """The orientation of PAF and SAM, where I consumes the query."""
    return F.translate(cigar, "DI", "ID")


def sam_cigar(cigar: Column, query_start: Column, query_end: Column, query_len: Column) -> Column:
    """SAM operations with soft clips for unaligned query ends; * if empty."""
    head = F.when(query_start > 0, F.concat(query_start.cast("string"), F.lit("S"))).otherwise("")
    tail = F.when(query_end < query_len, F.concat((query_len - query_end).cast("string"), F.lit("S"))).otherwise("")
    return F.when(F.length(cigar) == 0, "*").otherwise(F.concat(head, swap_gaps(cigar), tail))

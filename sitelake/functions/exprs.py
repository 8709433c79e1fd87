"""Column expressions. All of them stay inside JVM code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelake.functions import dims


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def rounded(value, digits: int = 6) -> Column:
    """Round half up by plain double arithmetic, the same in every engine."""
    scale = float(10**digits)
    return (F.floor(col(value) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)).cast("double")


def type_key(value) -> Column:
    text = F.lower(F.trim(col(value)))
    text = F.replace(text, F.lit("_"), F.lit("-"))
    text = F.replace(text, F.lit("  "), F.lit(" "))
    return F.replace(text, F.lit(" "), F.lit("-"))


def evidence_kept(evidence) -> Column:
    """Holds a keep phrase and no drop phrase. Two alternations, so the text expression is inlined twice at
    most; one test per phrase made the generated method too large for the JIT."""
    text = F.lower(F.trim(col(evidence)))
    hit = lambda phrases: F.rlike(text, F.lit("|".join(phrases)))
    return F.coalesce(hit(dims.EVIDENCE_KEEP) & ~hit(dims.EVIDENCE_DROP), F.lit(False))


def residue_code(residue) -> Column:
    """0..19 for the standard letters, 20 for anything else."""
    found = F.position(col(residue), F.lit(dims.RESIDUE_VOCABULARY))
    return F.coalesce(F.nullif(found, F.lit(0)) - 1, F.lit(20)).cast("bigint")


def stratum_of_residue(residue, table: dict[str, str] | None = None, default: str = "other") -> Column:
    table = table or {r: s for s, rs in dims.STRATUM_RESIDUES.items() for r in rs}
    out = reduce(lambda acc, kv: acc.when(col(residue) == kv[0], kv[1]), list(table.items())[1:],
                 F.when(col(residue) == next(iter(table)), next(iter(table.values()))))
    return out.otherwise(default)


def end_distance(position, length) -> Column:
    return F.least(col(position) - 1, col(length) - col(position))


def band_verdict(value, low, high) -> Column:
    v, lo, hi = col(value), col(low), col(high)
    return (
        F.when(lo.isNull() & hi.isNull(), "n/a")
        .when(F.coalesce(v < lo, F.lit(False)) | F.coalesce(v > hi, F.lit(False)), "fail")
        .otherwise("pass")
    )


def isoform_stem(accession) -> Column:
    return F.nullif(F.regexp_extract(col(accession), r"^(.*)-[0-9]+$", 1), F.lit(""))


def count_letters(sequence, letters: str) -> Column:
    """Occurrences of any of the letters, by string length differences."""
    seq = col(sequence)
    per_letter = [F.length(seq) - F.length(F.replace(seq, F.lit(letter), F.lit(""))) for letter in letters]
    return reduce(lambda a, b: a + b, per_letter).cast("bigint")


def sum_squares(vector) -> Column:
    return F.aggregate(col(vector), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))

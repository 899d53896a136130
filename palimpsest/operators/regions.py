"""Protected regions: lifted out of a text before it is rewritten, and put back byte for byte."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import fixed
from palimpsest.functions.strings import begun, found, literal

_EMPTY = "array<struct<kind:string,text:string>>"
#: Kinds in one selection: each is three columns that name earlier ones, and the analyzer resolves a bounded number of them at a time.
TOGETHER = 6


def count_of(c: Column, kind: str) -> Column:
    """Regions of one kind in a text, whatever other kinds would take."""
    return F.size(found(c, dict(fixed.REGIONS)[kind]))


def extract(df: DataFrame, column: str, skeleton: str = "skeleton", regions: str = "regions") -> DataFrame:
    """Adds the skeleton (numbered placeholders) and the regions. Kinds are applied one after the other; later ones may swallow earlier placeholders.

    Matches, skeleton and regions of each kind are columns of their own, built in one selection whose later columns name
    earlier ones. A pattern runs only on texts that hold what each of its matches must.
    """
    old = [f"`{c}`" for c in df.columns if c not in (skeleton, regions)]
    out = df.selectExpr(*old, f"replace(coalesce(`{column}`, ''), '{fixed.OPEN}', '{fixed.OPEN}{fixed.ESCAPE}') as __s0", f"cast(array() as {_EMPTY}) as __r0")
    for first in range(0, len(fixed.REGIONS), TOGETHER):
        steps, k = [], first
        for k, (kind, pattern) in enumerate(fixed.REGIONS[first : first + TOGETHER], first):
            pattern = begun(pattern, fixed.REGION_STARTS[kind]) if kind in fixed.REGION_STARTS else pattern
            s, r, m = f"__s{k}", f"__r{k}", f"__m{k}"
            matches, sign, shape = f"regexp_extract_all({s}, {literal(pattern)}, 0)", fixed.REGION_SIGNS.get(kind), fixed.REGION_SHAPES.get(kind)
            signs = [f"{test}({s}, {literal(held)})" for test, held in (("contains", sign), ("rlike", shape)) if held]
            steps.append(f"if({' and '.join(signs)}, {matches}, cast(array() as array<string>)) as {m}" if signs else f"{matches} as {m}")
            number = f"concat('{fixed.OPEN}', cast(size({r}) + i as string), '{fixed.CLOSE}')"
            pieces = f"transform(arrays_zip(split({s}, {literal(pattern)}, -1), {m}), (z, i) -> concat(z['0'], if(z['{m}'] is null, '', {number})))"
            steps.append(f"if(size({m}) = 0, {s}, array_join({pieces}, '')) as __s{k + 1}")
            steps.append(f"if(size({m}) = 0, {r}, concat({r}, transform({m}, t -> named_struct('kind', '{kind}', 'text', t)))) as __r{k + 1}")
        out = out.selectExpr(*old, f"__s{first}", f"__r{first}", *steps).selectExpr(*old, f"__s{k + 1}", f"__r{k + 1}")
    return out.selectExpr(*old, f"__s{len(fixed.REGIONS)} as `{skeleton}`", f"__r{len(fixed.REGIONS)} as `{regions}`")


def lost(skeleton: Column, regions: Column) -> Column:
    """Numbers of regions that neither the skeleton nor another region holds; such a skeleton can't be restored."""
    mark = lambda i: F.concat(F.lit(fixed.OPEN), i.cast("string"), F.lit(fixed.CLOSE))
    numbers = F.filter(F.sequence(F.lit(0), F.size(regions)), lambda i: i < F.size(regions))
    return F.filter(numbers, lambda i: ~F.contains(skeleton, mark(i)) & ~F.exists(regions, lambda r: F.contains(r["text"], mark(i))))


def restore(skeleton: Column, regions: Column) -> Column:
    """The text of a skeleton; null if a placeholder is lost. Later regions may hold earlier placeholders, so the highest number goes first."""
    back = F.aggregate(
        F.reverse(F.filter(F.sequence(F.lit(0), F.size(regions)), lambda i: i < F.size(regions))), skeleton,
        lambda s, i: F.replace(s, F.concat(F.lit(fixed.OPEN), i.cast("string"), F.lit(fixed.CLOSE)), F.get(regions, i)["text"]),
    )
    return F.when(F.size(lost(skeleton, regions)) == 0, F.replace(back, F.lit(fixed.OPEN + fixed.ESCAPE), F.lit(fixed.OPEN)))

"""Character spans of regular-expression matches as array columns, without a UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPANS = "array<struct<v:string,s:int,e:int>>"


def clean(text: Column) -> Column:
    """Text that spans can be taken of: one kind of newline, no control characters 1 and 2."""
    t = F.coalesce(text, F.lit(""))
    plain = F.translate(F.regexp_replace(t, r"\r\n?|[\u0085\u2028\u2029]", "\n"), "\x01\x02", "")
    return F.when(t.rlike(r"[\r\u0085\u2028\u2029\x01\x02]"), plain).otherwise(t)


def capitals(text: Column) -> Column:
    """ASCII letters as capitals; other characters stay, so that places do."""
    return F.when(F.octet_length(text) == F.length(text), F.upper(text)).otherwise(F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def spans(text: Column, pattern: str) -> Column:
    """All matches from left to right as (v, s, e)."""
    none = F.array().cast(SPANS)

    def step(acc: Column, part: Column) -> Column:
        v = F.substring_index(part, "\x02", 1)
        span = F.struct(v.alias("v"), acc["p"].alias("s"), (acc["p"] + F.length(v)).alias("e"))
        return F.struct((acc["p"] + F.length(part) - 1).alias("p"), F.concat(acc["a"], F.array(span)).alias("a"))

    # Most scans find nothing: then the text isn't taken apart.
    read = lambda parts: F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.struct(F.length(F.get(parts, F.lit(0))).alias("p"), none.alias("a")), step, lambda acc: acc["a"])
    return let(F.split(F.regexp_replace(text, pattern, "\x01$0\x02"), "\x01"), lambda parts: F.when(F.size(parts) > 1, read(parts)).otherwise(none))


def starting(chars: str, pattern: str) -> str:
    """The pattern behind a look at the next character, which most places of a text fail at once; chars: all that a match can start with, capitals aside."""
    both = sorted({c for x in chars for c in (x.lower(), x.upper())})
    return f"(?=[{''.join(c if c.isalnum() else chr(92) + c for c in both)}]){pattern}"


def leads(pattern: str) -> str:
    """The pattern, capitals aside, behind a look at the letters that it can start with, where it starts with plain words."""
    rest = pattern.removeprefix(r"\b")
    if rest[:3] == "(?:":
        depth, chars, fresh = 0, "", True
        for i, c in enumerate(rest[3:]):
            if depth == 0 and c == ")":
                break
            if depth == 0 and fresh:
                chars += c
            fresh = depth == 0 and c == "|"
            depth += (c == "(") - (c == ")")
        after = rest[3 + i + 1 : 3 + i + 2]
    else:
        plain = rest[1:] if rest[0] == "(" else rest
        chars, after = plain[0], plain[1]
    return "(?i)" + (starting(chars, pattern) if chars.isalnum() and chars.isascii() and after not in ("?", "*", "{", "|") else pattern)


def let(value: Column, use) -> Column:
    """use(value) with value evaluated once, inside lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(*phrases: str) -> str:
    """A pattern of phrases whose words may stand with or without blanks between them; longest first."""
    ordered = sorted(phrases, key=len, reverse=True)
    return r"(?i:\b(?:" + "|".join(r"[ \t]*".join(w for w in p.split(" ")) for p in ordered) + r")\b)"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are evaluated once for a row.

    Projections would be merged into the expressions that use them, and an array used inside
    a lambda would then be made anew for every element; a one-row generator keeps them apart.
    """
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def cleaned(df: DataFrame) -> DataFrame:
    """Adds t, the text that spans are taken of, unless it is there."""
    return df if "t" in df.columns else once(df, t=clean(F.col("text")))

"""Column functions on texts: normal forms, buckets, answers, action texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepwise.functions.geometry import bound

# The split's buckets and the names of its parts.
SPLIT_BUCKETS = 10_000


def collapsed(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed; null counts as empty."""
    # Blanks of ASCII alone, named one by one, are found many times faster.
    plain, any_blank = r"[ \t\n\x0b\f\r\x1c\x1d\x1e\x1f]+", r"(?U)[\s\x1c-\x1f]+"

    def one(low: Column) -> Column:
        return F.trim(F.when(F.octet_length(low) == F.length(low), F.regexp_replace(low, plain, " ")).otherwise(F.regexp_replace(low, any_blank, " ")))

    return bound(F.lower(F.coalesce(text, F.lit(""))), one)


def md5_mod(text: Column, modulus: int = SPLIT_BUCKETS) -> Column:
    """The 128-bit md5 of a text modulo a number, by 32-bit parts."""

    def rest(digest: Column) -> Column:
        out = F.lit(0).cast("long")
        for i in range(4):
            part = F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")
            out = (out * (2**32 % modulus) + part) % modulus
        return out

    return bound(F.md5(text.cast("binary")), rest)


def identity(text: Column) -> Column:
    """128 bits that stand for a text where texts are told apart or counted, so that none is shuffled; null for null."""
    return F.unhex(F.md5(text.cast("binary")))


def split_of(bucket: Column, train: float = 0.8, val: float = 0.1) -> Column:
    """train, val or test by a bucket."""
    return F.when(bucket < int(train * SPLIT_BUCKETS), "train").when(bucket < int((train + val) * SPLIT_BUCKETS), "val").otherwise("test")


def split_name(text: Column, train: float = 0.8, val: float = 0.1) -> Column:
    """train, val or test by the hash of the instruction's normal form."""
    return bound(md5_mod(collapsed(text)), lambda b: split_of(b, train, val))


def uniform(key: Column, attempt: Column, axis: str, seed: int = 42) -> Column:
    """A number in [0, 1) that the key, the attempt and the axis fix."""
    text = F.concat_ws("|", F.lit(str(seed)), key, attempt.cast("string"), F.lit(axis))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / float(1 << 32)


def answer(text: Column) -> Column:
    """Yes or No if an answer begins with it or has just one of the words, else Unknown."""
    clean = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")))
    words = F.split(F.regexp_replace(clean, "[.,]", " "), r"\s+")
    yes, no = F.array_contains(words, "yes"), F.array_contains(words, "no")
    return F.when(clean.startswith("yes"), "Yes").when(clean.startswith("no"), "No").when(yes & ~no, "Yes").when(no & ~yes, "No").otherwise("Unknown")


def compact(text: Column, most: int = 220) -> Column:
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n]", " "))
    return F.when(F.length(clean) > most, F.concat(F.substring(clean, 1, most - 3), F.lit("..."))).otherwise(clean)


def number_text(value: Column) -> Column:
    """A double as its shortest exact text: plain from 1e-4 to 1e16, beyond with an exponent of two digits or more."""
    text, size = value.cast("double").cast("string"), F.abs(value)
    plain = F.regexp_replace(F.regexp_replace(text.cast("decimal(38,21)").cast("string"), "0+$", ""), r"\.$", ".0")
    mantissa = F.regexp_replace(F.regexp_extract(text, "^([^E]*)E", 1), r"\.0$", "")
    power = F.regexp_extract(text, "E-?([0-9]+)$", 1)
    power = F.when(F.length(power) < 2, F.concat(F.lit("0"), power)).otherwise(power)
    long = F.concat(mantissa, F.when(F.contains(text, F.lit("E-")), "e-").otherwise("e+"), power)
    return F.when(~F.contains(text, F.lit("E")), text).when((size >= 1e-4) & (size < 1e16), plain).otherwise(long)


def point_text(p: Column) -> Column:
    return F.when(p.isNull(), "None").otherwise(F.concat(F.lit("["), number_text(p["x"]), F.lit(", "), number_text(p["y"]), F.lit("]")))


def quoted(text: Column) -> Column:
    """A string literal: in single quotes, in double ones if it has single ones only."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), "\n", r"\\n"), "\r", r"\\r"), "\t", r"\\t")
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    return F.when(text.isNull(), "None").when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def _literal(text: Column) -> Column:
    return F.coalesce(quoted(text), F.lit("None"))


def mapping_text(action: Column) -> Column:
    """An action as a mapping of its fields, in literals."""
    points = [F.concat(F.lit(f"'{k}': "), point_text(action[k])) for k in ("point", "start_point", "end_point")]
    words = [F.concat(F.lit(f"'{k}': "), _literal(action[k])) for k in ("text", "direction", "coordinate_space")]
    told = F.transform(F.map_entries(action["metadata"]), lambda e: F.concat(_literal(e["key"]), F.lit(": "), _literal(e["value"])))
    facts = F.concat(F.lit("'metadata': {"), F.coalesce(F.array_join(told, ", "), F.lit("")), F.lit("}"))
    return F.concat(F.lit("{"), F.concat_ws(", ", F.concat(F.lit("'type': "), _literal(action["type"])), *points, *words, facts), F.lit("}"))


def action_text(action: Column) -> Column:
    """An action as a call, for prompts; types without a form of their own as a mapping."""
    kind = action["type"]
    return (
        F.when(kind == "click", F.concat(F.lit("click(point="), point_text(action["point"]), F.lit(")")))
        .when(kind == "swipe", F.concat(F.lit("swipe(start_point="), point_text(action["start_point"]), F.lit(", end_point="), point_text(action["end_point"]), F.lit(")")))
        .when(kind == "type", F.concat(F.lit("type(text="), quoted(action["text"]), F.lit(")")))
        .when(kind.isin("back", "home", "wait", "finish", "impossible"), kind)
        .otherwise(mapping_text(action))
    )


# The lines of a scorer prompt.
def prompt(instruction: Column, action: Column, question: str) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("Instruction: "), instruction), F.concat(F.lit("Candidate action: "), action), F.lit(question), F.lit("Answer only Yes or No."))

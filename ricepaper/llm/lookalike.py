"""One consistent form for texts that look the same but are written in different characters.

Method. Every distinct value is mapped to its look: compatibility forms (width, ligatures) are
folded, invisible characters dropped, blanks of any kind joined, letters of other alphabets with
the shape of a Latin letter replaced, accents put into one order and composed. Values are then
grouped by that look under Spark's accent- and case-sensitive ``UNICODE`` collation in SQL; each
class gets one deterministic canonical member, which is joined back to the rows.

What stays different: case, missing or other accents, the letter that bears the tone mark,
hyphens, and digits against letters.

Scale. The mapping runs once per distinct value, in Arrow batches; grouping is one hash
aggregation on the look with map-side combining, so a value held by a third of all rows is one
row after the first stage. Only classes with more than one member are joined back.

Defined results. A null value has a null look and no class; a value with nothing visible has the
look '' and is its own class; repeated rows give the same answer; extra columns pass through.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other alphabets, and variants of Latin letters, with a Latin shape.
SAME_SHAPE = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "ү": "y", "ɡ": "g",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ӏ": "I", "Ԍ": "G",
    # Greek
    "ο": "o", "ν": "v", "ι": "i", "α": "a", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j", "γ": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "զ": "q", "ց": "g", "Օ": "O", "Տ": "S", "Լ": "L",
    # variants of Latin letters
    "ı": "i", "ɩ": "i", "ɑ": "a", "ſ": "f", "Ð": "Đ", "Ɖ": "Đ",
}

# Hyphens that look like the plain one, and letters that look dotless.
SAME_HYPHEN = {"‐": "-", "‑": "-", "﹣": "-", "－": "-"}

# Accents of a Vietnamese vowel, the letter's own mark before the tone.
MARK_ORDER = {"̛": 0, "̂": 1, "̆": 1, "̀": 2, "́": 2, "̃": 2, "̉": 2, "̣": 2}

# Combining marks that draw the same accent.
SAME_MARK = {"̀": "̀", "́": "́", "̐": "̆"}


@lru_cache(maxsize=1 << 16)
def _look_of_char(ch: str) -> str:
    if ch in SAME_SHAPE:
        return SAME_SHAPE[ch]
    if ch in SAME_HYPHEN:
        return SAME_HYPHEN[ch]
    kind = unicodedata.category(ch)
    if ch.isspace() or kind == "Zs" or ch in "⠀ㅤﾠ":
        return " "
    if kind in ("Cf", "Cc") or "︀" <= ch <= "️" or ch in "͏ᅟᅠ឴឵":
        return ""
    wide = unicodedata.decomposition(ch).startswith(("<wide>", "<narrow>", "<font>", "<compat>", "<noBreak>"))
    if wide:
        return "".join(_look_of_char(x) for x in unicodedata.normalize("NFKC", ch))
    parts = unicodedata.normalize("NFD", ch)
    if len(parts) > 1:
        return "".join(_look_of_char(x) for x in parts)
    return SAME_MARK.get(ch, ch)


def look(value: str | None) -> str | None:
    """The look of ``value``; equal for two values that a reader can't tell apart."""
    if value is None:
        return None
    if value.isascii():
        return " ".join(value.split())
    out: list[str] = []
    marks: list[str] = []

    def close() -> None:
        if marks:
            out.extend(sorted(marks, key=lambda m: (MARK_ORDER.get(m, 3), m)))
            marks.clear()

    for ch in "".join(map(_look_of_char, value)):
        if unicodedata.combining(ch):
            marks.append(ch)
        else:
            close()
            out.append(ch)
    close()
    return unicodedata.normalize("NFC", " ".join("".join(out).split()))


@F.pandas_udf(T.StringType())
def look_udf(values: pd.Series) -> pd.Series:
    return values.map(look, na_action="ignore")


def look_column(column: str | Column) -> Column:
    """The look as a column; plain ASCII without repeated blanks never leaves the JVM."""
    c = F.col(column) if isinstance(column, str) else column
    plain = c.rlike(r"^[\x21-\x7e]+( [\x21-\x7e]+)*$")
    return F.when(plain, c).otherwise(look_udf(F.when(~plain, c)))


def look_classes(values: DataFrame, column: str) -> DataFrame:
    """``(value, canonical, members)`` of the distinct non-null values of ``column``.

    The canonical member is the one that equals its look if there is one, else the shortest, else
    the first in code point order.
    """
    distinct = values.select(F.col(column).alias("value")).where("value is not null").distinct()
    looks = distinct.withColumn("look", look_column("value"))
    return values.sparkSession.sql(
        """
        SELECT v.value, c.canonical, c.members
        FROM {looks} v JOIN (
            SELECT look COLLATE UNICODE AS look, count(*) AS members,
                   min_by(value, struct(value <> look, length(value), value)) AS canonical
            FROM {looks} GROUP BY look COLLATE UNICODE
        ) c ON v.look COLLATE UNICODE = c.look
        """,
        looks=looks,
    )


def with_canonical(rows: DataFrame, column: str, to: str = "canonical") -> DataFrame:
    """``rows`` with the canonical form of ``column`` in ``to``; null stays null.

    Values alone in their class keep themselves without being joined.
    """
    shared = look_classes(rows, column).where("members > 1 and canonical <> value").select(F.col("value").alias("__value"), F.col("canonical").alias("__canonical"))
    return rows.join(shared, rows[column] == shared["__value"], "left").withColumn(to, F.coalesce("__canonical", rows[column])).drop("__value", "__canonical")


def alias_entries(aliases: DataFrame) -> DataFrame:
    """Distinct ``(canonical, alias_pos, alias)``; null elements keep their positions and are left out."""
    return (
        aliases.where("canonical is not null").select("canonical", F.posexplode("aliases").alias("alias_pos", "alias"))
        .where("alias is not null").distinct()
    )


def course_names(graph: DataFrame, lang: str = "vi") -> DataFrame:
    """Distinct ``(course_id, name)`` of one language."""
    return graph.select(F.col("id").alias("course_id"), F.col("name")[lang].alias("name")).where("course_id is not null and name is not null").distinct()


def same_look_pairs(graph: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(course_id, canonical, alias_pos)`` of names and aliases that look the same but differ.

    Names without anything visible match nothing.
    """
    names, entries = course_names(graph), alias_entries(aliases)
    classes = look_classes(names.select(F.col("name").alias("value")).unionByName(entries.select(F.col("alias").alias("value"))), "value")
    shared = classes.where("members > 1").select("value", F.col("canonical").alias("form")).where(r"form rlike '\\S'")
    left = names.join(shared.withColumnRenamed("value", "name"), "name")
    right = entries.join(shared.withColumnRenamed("value", "alias"), "alias")
    return left.join(right, "form").where("name <> alias").select("course_id", "canonical", F.col("alias_pos").cast("int").alias("alias_pos")).distinct()

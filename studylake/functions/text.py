"""Rich-text clean-up and choice-list parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The blanks that are trimmed (space separators and the control blanks), and white space as a pattern.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"
BLANK = r"[\x09-\x0D\x85\p{Z}]"

# Markup that is dropped, and the entities that are decoded. `&amp;` comes last so that the text
# it uncovers is not decoded a second time.
DROPPED_BLOCKS = r"(?s)<script.*?</script>|<style.*?</style>"
TAG = r"<[^>]+>"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def trim_blank(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def _let(value: Column, use) -> Column:
    """Evaluate `value` once and use it in several places of an expression."""
    return F.transform(F.array(value), use)[0]


def strip_markup(text: Column) -> Column:
    """Plain text of a rich-text label."""
    # Without a closing tag there is no block, and no need to look for its end behind every opening one.
    closed = F.contains(text, F.lit("</script>")) | F.contains(text, F.lit("</style>"))
    plain = F.when(closed, F.regexp_replace(text, DROPPED_BLOCKS, " ")).otherwise(text)
    plain = F.regexp_replace(plain, TAG, " ")
    for entity, char in ENTITIES:
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return trim_blank(F.regexp_replace(plain, r"[ \t\r\n]+", " "))


def _labelled(part: Column) -> Column:
    """One trimmed choice -> its id and label.

    The text before the first comma, or else the first equals sign, is the id and the rest the label. Without
    either sign, with nothing on one side of it, or with a label over several lines, the choice is both.
    """
    sign = F.when(F.contains(part, F.lit(",")), ",").when(F.contains(part, F.lit("=")), "=")
    left = F.call_function("substring_index", part, sign, F.lit(1))
    right = F.substr(part, F.length(left) + 2)
    sides = F.struct(trim_blank(left).alias("id"), trim_blank(right).alias("label"))
    whole = F.struct(part.alias("id"), part.alias("label"))

    def checked(cut: Column) -> Column:
        good = (cut["id"] != "") & (cut["label"] != "") & ~F.contains(cut["label"], F.lit("\n"))
        return F.when(good, cut).otherwise(whole)

    return F.when(sign.isNull(), whole).otherwise(_let(sides, checked))


def split_choices(text: Column) -> Column:
    """`"1, Male | 2, Female"` -> array of (pos, id, label), positions from 1, empty choices skipped."""
    parts = F.filter(F.transform(F.split(text, r"\|"), trim_blank), lambda part: part != "")
    return F.transform(
        F.transform(parts, _labelled),
        lambda choice, i: F.struct((i + 1).cast("int").alias("pos"), choice["id"].alias("id"), choice["label"].alias("label")),
    )


def numeric_choice(choice_id: Column) -> Column:
    """Integer of a numeric choice id, halves to even; NULL for any other id."""
    return F.coalesce(
        choice_id.try_cast("bigint"),
        F.when(choice_id.rlike(NUMBER), F.rint(choice_id.try_cast("double")).try_cast("bigint")),
    )


def choice_items(text: Column) -> Column:
    """Choice text -> array of (pos, value, code, description) in choice order.

    Non-numeric ids are numbered 1, 2, 3 … among themselves. The numbering is done inside the array, so a
    dictionary needs no shuffle and no window to be turned into code lists.
    """
    def valued(c: Column) -> Column:
        return F.struct(c["pos"], numeric_choice(c["id"]).alias("number"), c["id"], c["label"])

    def item(c: Column, value: Column, code: Column) -> Column:
        return F.struct(
            c["pos"].alias("pos"), value.alias("value"), code.alias("code"), c["label"].alias("description")
        )

    def numbered(choices: Column) -> Column:
        numeric = F.filter(choices, lambda c: c["number"].isNotNull())
        other = F.filter(choices, lambda c: c["number"].isNull())
        code_of_label = lambda c: F.regexp_replace(F.lower(c["label"]), rf"{BLANK}+", "_")
        return F.concat(
            F.transform(numeric, lambda c: item(c, c["number"], code_of_label(c))),
            F.transform(other, lambda c, i: item(c, (i + 1).cast("bigint"), c["id"])),
        )

    return F.sort_array(_let(F.transform(split_choices(text), valued), numbered))

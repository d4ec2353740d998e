"""Text columns: ids, rendered messages, and fields read out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(*values: Column) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values[:-1]], values[-1])


def upper_code(value: Column) -> Column:
    return F.upper(value)


def stable_id(prefix: str, *parts: Column) -> Column:
    """128 bits of a digest: a rerun gives the same id, and different parts never the same text.

    Each part goes in with its length, a NULL part as a dash.
    """
    marked = [F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"),
                                  p.cast("string")), F.lit("-")) for p in parts]
    return F.concat(F.lit(f"{prefix}-"), F.upper(F.substring(F.sha2(F.concat(*marked), 256), 1, 32)))


def recommendation_id(sku: Column, room: Column, stamp: Column) -> Column:
    return F.concat_ws("-", sku.cast("string"), room.cast("string"),
                       F.date_format(stamp, "yyyyMMddHHmmss"))


def rationale(on_hand: Column, reorder_point: Column, trend: Column, score: Column) -> Column:
    """Facts behind a decision; a fact that is NULL is left out."""
    facts = [
        ("on_hand_g", on_hand, 0, ""),
        ("reorder_g", reorder_point, 0, ""),
        ("input24h", trend * 100, 2, "%"),
        ("ml_score", score, 3, ""),
    ]
    return F.concat_ws(" · ", *[
        F.concat(F.lit(f"{label}="), F.format_number(value, digits), F.lit(unit))
        for label, value, digits, unit in facts
    ])


def order_address(name: Column, supplier_id: Column) -> Column:
    """Order mailbox from the first word of the supplier's name."""
    shown = truthy(name, supplier_id.cast("string"))
    first_word = F.regexp_extract(F.lower(shown), r"(\S+)", 1)
    return F.concat(F.lit("orders@"), F.replace(first_word, F.lit("'"), F.lit("")), F.lit(".demo"))


def append_reason(rationale_text: Column, reason: str = "BUDGET_EXCEEDED") -> Column:
    return F.concat(F.coalesce(rationale_text, F.lit("")), F.lit(f" | {reason}"))


def short_notes(notes: Column, length: int = 180) -> Column:
    return F.substring(F.coalesce(notes, F.lit("")), 1, length)


def default_score(score: Column) -> Column:
    """Missing or zero model score counts as undecided."""
    return F.coalesce(F.nullif(score, F.lit(0.0)), F.lit(0.5))


def default_verdict(verdict: Column) -> Column:
    return F.upper(F.coalesce(verdict, F.lit("SCREENING")))


def rfq_prompt(sku: Column, grams: Column, packs: Column, pack_grams: Column,
               price: Column, lead_days: Column, supplier: Column) -> Column:
    """Request text from the fields of a recommendation; halves of a gram round to even."""
    return F.format_string(
        "To %s: please offer %.0f g of item %s as %d packs of %.0f g.\n"
        "Our board shows $%.2f a pack, delivered within %d days.",
        supplier.cast("string"), F.bround(grams, 0), sku.cast("string"), packs,
        F.bround(pack_grams, 0), price, lead_days,
    )


def application_prompt(name: Column, country: Column, contact: Column, skus: Column,
                       organic: Column, years: Column) -> Column:
    return F.format_string(
        "%s from %s applies as a supplier of: %s.\n"
        "Organic certificate: %s; trading for %d years; write to %s.",
        name, country, skus, organic.cast("string"), years, contact,
    )


def json_object_text(text: Column) -> Column:
    """Outermost `{…}` of a text: drops code fences and prose around it. None → NULL."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def json_extract(text: Column, schema: str) -> Column:
    """Struct read from the object inside `text`, tolerant of raw control characters.

    The extra field `malformed` holds the text that could not be read.
    """
    options = {"allowUnquotedControlChars": "true", "mode": "PERMISSIVE",
               "columnNameOfCorruptRecord": "malformed"}
    return F.from_json(json_object_text(text), f"{schema}, malformed STRING", options)


def quote_fields(extracted_json: Column) -> Column:
    """Price, pack and lead time from a reply's JSON; unreadable JSON gives NULL fields."""
    return F.from_json(
        extracted_json,
        "unit_price_usd DOUBLE, pack_size_g DOUBLE, lead_time_days INT",
        {"mode": "PERMISSIVE", "allowUnquotedControlChars": "true"},
    )


def _number_after(text: Column, pattern: str) -> Column:
    """The number a pattern finds, without its thousands separators."""
    found = F.regexp_extract(text, pattern, 1)
    return F.nullif(F.replace(found, F.lit(","), F.lit("")), F.lit(""))


_NUMBER = r"([0-9][0-9,]*(?:\.[0-9]+)?)"


def reply_price(reply: Column) -> Column:
    return _number_after(reply, rf"\$\s*{_NUMBER}").try_cast("double")


def reply_pack(reply: Column) -> Column:
    return _number_after(reply, rf"(?i)\bpack of\s+{_NUMBER}\s*g\b").try_cast("double")


def reply_lead_days(reply: Column) -> Column:
    """Days to delivery; a number no int holds cannot be read and gives NULL."""
    return _number_after(reply, r"(?i)\blead time:?\s+([0-9][0-9,]*)").try_cast("int")


def _mentions(low: Column, stem: str, pattern: str) -> Column:
    """A whole word or phrase occurs; the plain search for its stem spares most texts the pattern."""
    return low.contains(stem) & low.rlike(pattern)


_NOT = r"\b(?:not|never|no longer|cannot|can't|don't|won't|unable to)\s+(?:\w+\s+)?"


def reply_organic(reply: Column) -> Column:
    low = F.lower(reply)
    denied = (_mentions(low, "organic", r"\b(?:not|non|never)[\s-]+(?:certified\s+)?organic\b")
              | _mentions(low, "conventional", r"\bconventional(?:ly)?\b"))
    return F.when(denied, F.lit(False)).when(
        _mentions(low, "organic", r"\borganic(?:ally)?\b"), F.lit(True))


def reply_intent(reply: Column) -> Column:
    """Keyword reading of a supplier's reply; plain quotes are the default.

    Words count whole, and an acceptance that is denied is a rejection.
    """
    low = F.lower(reply)
    agree = r"(?:accept(?:s|ed|able)?|confirm(?:s|ed)?)\b"
    checks = [
        ("OOF", _mentions(low, "out of office", r"\bout of office\b")),
        ("REJECT", _mentions(low, "unable to", r"\bunable to\b")
         | _mentions(low, "cannot", r"\bcannot\b")
         | _mentions(low, "decline", r"\bdeclined?s?\b")
         | _mentions(low, "regret", r"\bregrets?\b")
         | _mentions(low, "unacceptable", r"\bunacceptable\b")
         | _mentions(low, "accept", _NOT + agree) | _mentions(low, "confirm", _NOT + agree)),
        ("COUNTER", _mentions(low, "counter", r"\bcounter(?:s|ed|[\s-]?offer\w*|[\s-]?propos\w*)?\b")),
        ("ACCEPT", _mentions(low, "accept", r"\b" + agree) | _mentions(low, "confirm", r"\b" + agree)),
    ]
    return F.coalesce(*[F.when(found, F.lit(intent)) for intent, found in checks], F.lit("QUOTE"))

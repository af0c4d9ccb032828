"""JSON and names inside free text, and loose field lookup in variants."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from listingflow import vocabulary as V
from listingflow.functions.text import PY_SPACE, PY_SPACES, let, trim

_FENCE = "```json"
#: Stands after a text that is parsed, so that a value that ends early is told. No character of it has a short escape.
_END = "<end of text>"


def _fenced(t: Column) -> Column:
    """Text of the first fenced JSON block, null without one or if it is empty."""
    def block(rest):
        return let(F.split(rest, "```", 2), lambda parts: F.when(F.size(parts) == 2, trim(F.get(parts, F.lit(0)))))

    # A cut by position would step through the characters of the whole text.
    return let(F.split(t, _FENCE, 2), lambda parts: block(F.get(parts, F.lit(1))))


def _widest(t: Column, opening: str, closing: str) -> Column:
    """From the first opening to the last closing character, null without both."""
    start = F.position(F.lit(opening), t)
    tail = F.length(F.substring_index(t, closing, -1))      # all of it without a closing
    return F.when(start > 0, let(F.length(t) - tail - start + 1, lambda size: F.when(
        size > 1, F.substring(t, start, size))))


def parse_json(c: Column, as_type: str = "variant") -> Column:
    """The whole text as a variant, or read as ``as_type``; null if anything follows the first value.

    The parser stops after one value. In an array with the text, an end mark comes second only if the text is one
    value. A text that may hold the mark itself is parsed twice: what follows a value in it cannot close both an
    object and an array around the text, so it shows in one of them.
    """
    def marked(t):
        pair = F.try_parse_json(F.concat(F.lit("["), t, F.lit(f',"{_END}"]')))
        return let(pair, lambda v: F.when(
            F.try_variant_get(v, "$[1]", "string") == _END, F.try_variant_get(v, "$[0]", as_type)))

    def wrapped(t):
        inside = F.try_parse_json(F.concat(F.lit('{"v":'), t, F.lit("}")))
        listed = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
        return F.when(listed.isNotNull(), F.try_variant_get(inside, "$.v", as_type))

    return let(c, lambda t: F.when(t.contains("\\u") | t.contains(_END), wrapped(t)).otherwise(marked(t)))


def reply_json(c: Column, objects_only: bool = False, as_type: str = "variant") -> Column:
    """JSON inside a reply as a variant, or read as ``as_type``; null if there is none that parses.

    A fenced block is tried first, then the widest array, then the widest object.
    """
    def found(t):
        widest = _widest(t, "{", "}")
        if objects_only:
            return widest
        return F.when(t.contains(_FENCE), F.coalesce(
            _fenced(t), _widest(t, "[", "]"), widest)).otherwise(
            F.coalesce(_widest(t, "[", "]"), widest))

    return parse_json(let(c, found), as_type)


def variant_array(v: Column, path: str = "$") -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def field_texts(v: Column, fields: Iterable[str]) -> Column:
    """The fields of an object as a struct of texts, null if it is no object. All are read in one pass."""
    return F.try_variant_get(v, "$", f"struct<{', '.join(f'{f}: string' for f in dict.fromkeys(fields))}>")


def first_value(v: Column, fields: Iterable[str], default: str | None = None, texts: Column | None = None) -> Column:
    """The first field that is set, as text; '', 0, false and null count as unset.

    ``texts`` is a column of ``field_texts``, for rows of which many fields are read: a look into ``v`` walks its keys.
    """
    def is_set(field):
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))
        return lambda t: F.when((t != "") & (~t.isin("0", "false") | (kind == "STRING")), t)

    def is_set_text(field):
        # The look into the variant stands in a lambda, since generated code would else do it for each row.
        t, value = texts[field], F.try_variant_get(v, f"$.{field}", "variant")
        told = let(value, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.lit(True)))
        return F.when(t.isin("0", "false"), F.when(told, t)).when(t != "", t)

    values = [let(F.try_variant_get(v, f"$.{f}", "string"), is_set(f)) if texts is None else is_set_text(f)
              for f in fields]
    return F.coalesce(*values, F.lit(default))


def organization_from_text(c: Column) -> Column:
    """The word before the first organization noun, in title case."""
    words = F.split(F.lower(trim(c, PY_SPACES)), f"{PY_SPACE}+")

    def before_noun(ws):
        hits = F.transform(ws, lambda w, i: F.when(
            (i > 0) & w.isin(V.ORGANIZATION_NOUNS), F.get(ws, i - 1)))
        return F.get(F.filter(hits, lambda w: w.isNotNull()), F.lit(0))

    name = let(words, before_noun)
    runs = F.regexp_extract_all(name, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.coalesce(F.array_join(F.transform(runs, F.initcap), ""),
                      F.lit(V.UNKNOWN_ORGANIZATION))

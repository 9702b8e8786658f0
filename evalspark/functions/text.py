"""Text Column builders: Python-exact word splitting, middle cropping, prompt templates, chat requests.

All functions return JVM-side expressions (no Python UDF) and are safe in streaming plans. Those over
word arrays (``transform``, ``filter``) are interpreted, the others are inside whole-stage codegen.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.split()`` treats as whitespace (``str.isspace``), written as a
# regex character-class body that Java regex (Spark) and RE2 (DuckDB) read the same way:
# TAB, LF, VT, FF, CR, U+001C..U+001F, SPACE, U+0085, U+00A0, U+1680, U+2000..U+200A, U+2028, U+2029,
# U+202F, U+205F, U+3000.
PY_WHITESPACE = (
    r"\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WORD_PATTERN = f"[^{PY_WHITESPACE}]+"
# The same set for Java regex, faster to match: Character.isWhitespace plus the four characters Python
# also treats as whitespace (U+0085, U+00A0, U+2007, U+202F). Checked equal on every code point.
SPARK_WHITESPACE = r"\p{javaWhitespace}\x{85}\x{a0}\x{2007}\x{202f}"
SPARK_WORD = f"[^{SPARK_WHITESPACE}]+"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


WS_RUN = f"[{SPARK_WHITESPACE}]+"


def words(text: str | Column) -> Column:
    """``text.split()``: tokens separated by any Python whitespace, never an empty token.

    ``split`` on whitespace runs leaves at most an empty first/last token (leading/trailing whitespace);
    ``array_remove`` drops them. Faster than extracting every regex match.
    """
    return F.array_remove(F.split(_col(text), WS_RUN), "")


def word_count(text: str | Column) -> Column:
    """``len(text.split())`` as bigint. One reference to ``text``: when ``text`` is itself an expensive
    expression outside codegen (a crop), it is evaluated once."""
    return F.regexp_count(_col(text), F.lit(SPARK_WORD)).cast("bigint")


def _part(size: int | float, n: Column, name: str) -> Column:
    if isinstance(size, bool) or not isinstance(size, (int, float)):
        raise TypeError(f"{name} must be an int (word count) or a float (fraction), got {size!r}")
    if size < 0:
        raise ValueError(f"{name} must not be negative, got {size!r}")
    if isinstance(size, float):
        return F.floor(n * F.lit(size)).cast("int")
    return F.lit(int(size))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body`` (a lambda variable), so an expensive
    expression referenced in several branches is not recomputed."""
    return F.element_at(F.transform(F.array(value), body), 1)


def crop_middle(text: str | Column, head: int | float, tail: int | float, dedupe: bool = False) -> Column:
    """Keep the first ``head`` and last ``tail`` words, joined by one space.

    An int is a word count, a float a fraction of the words (floored). Reference behaviour is kept by
    default: ``tail == 0`` keeps the whole text as tail and overlapping parts repeat. ``dedupe=True``
    returns the text once when ``head + tail`` covers it and adds no tail for 0.
    """

    def body(toks: Column) -> Column:
        n = F.size(toks)
        h = _part(head, n, "head")
        t = _part(tail, n, "tail")
        head_part = F.slice(toks, F.lit(1), h)
        if dedupe:
            last = F.when(t == 0, F.array().cast("array<string>")).otherwise(F.slice(toks, -t, t))
            out = F.when(h + t >= n, toks).otherwise(F.concat(head_part, last))
        else:
            # slice(x, -k, k) is only evaluated for 0 < k < n (start 0 is invalid, beyond n is empty).
            last = F.when((t == 0) | (t >= n), toks).otherwise(F.slice(toks, -t, t))
            out = F.concat(head_part, last)
        return F.array_join(out, " ")

    return F.when(_col(text).isNull(), F.lit(None).cast("string")).otherwise(let(words(text), body))


# ---------------------------------------------------------------- templates (plan-time constants)


def _parse_template(template: str) -> list[tuple[str, str | None]]:
    parts: list[tuple[str, str | None]] = []
    for literal, field, spec, conversion in string.Formatter().parse(template):
        if field is None:
            parts.append((literal, None))
            continue
        if not field or not field.isidentifier():
            raise ValueError(f"template slot {{{field}}} is not a plain name (positional, attribute or index)")
        if spec or conversion:
            raise ValueError(f"template slot {{{field}}} uses a format spec or conversion; not supported")
        parts.append((literal, field))
    return parts


def template_fields(template: str) -> list[str]:
    """Names of the ``{field}`` slots, in first-use order; ``{{x}}`` is a literal."""
    seen: list[str] = []
    for _, field in _parse_template(template):
        if field is not None and field not in seen:
            seen.append(field)
    return seen


def validate_prompt_fields(template: str, content_columns: Iterable[str]) -> None:
    """KeyError naming fields present on one side only (checked once per plan, not per row)."""
    slots = set(template_fields(template))
    cols = set(content_columns)
    missing_in_prompt = sorted(cols - slots)
    missing_in_content = sorted(slots - cols)
    msg = ""
    if missing_in_prompt:
        msg += f"content has fields the template does not use: {missing_in_prompt}. "
    if missing_in_content:
        msg += f"template has fields the content lacks: {missing_in_content}."
    if msg:
        raise KeyError(msg.strip())


def render_prompt(template: str, fields: Mapping[str, str | Column] | None = None) -> Column:
    """``template.format(**row)`` as one ``concat``; braces inside the values stay literal.

    ``fields`` maps slot names to columns (default: the column of the same name). NULL content gives a
    NULL prompt.
    """
    fields = dict(fields or {})
    pieces: list[Column] = []
    for literal, field in _parse_template(template):
        if literal:
            pieces.append(F.lit(literal))
        if field is not None:
            pieces.append(_col(fields.get(field, field)).cast("string"))
    if not pieces:
        return F.lit("")
    return F.concat(*pieces) if len(pieces) > 1 else pieces[0]


def escape_braces(text: str) -> str:
    """Make a literal safe to embed in a template."""
    return text.replace("{", "{{").replace("}", "}}")


# Fixed value: the line format of an inlined few-shot example: - NAME (name): "text"
FEW_SHOT_LINE = '- {upper} ({name}): "{text}"'


def few_shot_block(examples: Iterable[tuple[str, str]]) -> str:
    """The inlined example list, one ``FEW_SHOT_LINE`` per example, braces escaped."""
    lines = [FEW_SHOT_LINE.format(upper=name.upper(), name=name, text=escape_braces(text)) for name, text in examples]
    return "\n".join(lines)


def few_shot_template(base_template: str, examples: Iterable[tuple[str, str]], slot: str = "examples") -> str:
    """PRJ-5: ``base_template`` with its ``{examples}`` slot replaced by the inlined example list; every
    other slot stays a slot. Examples are a bounded driver-side list (name, text)."""
    marker = "{" + slot + "}"
    if marker not in base_template:
        raise KeyError(f"template has no {marker} slot")
    return base_template.replace(marker, few_shot_block(examples))


def chat_messages(system: str | Column, user: str | Column) -> Column:
    """The two-message chat request ``[{system}, {user}]`` as ``array<struct<role, content>>``."""
    sys_col = F.lit(system) if isinstance(system, str) else system
    return F.array(
        F.struct(F.lit("system").alias("role"), sys_col.cast("string").alias("content")),
        F.struct(F.lit("user").alias("role"), _col(user).cast("string").alias("content")),
    )


def render_chat(messages: str | Column) -> Column:
    """Flatten a message array into one transcript string ``role: content`` per line."""
    return F.array_join(F.transform(_col(messages), lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")

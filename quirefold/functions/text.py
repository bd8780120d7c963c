"""Text functions as built-in column expressions: they stay in whole-stage code generation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: JavaScript's and Java's `$` differ before a final line feed, hence \z.
_RUNS, _TAIL = r'[<>:"\\/|?*]+', r"[. ]+\z"


def file_name(name: Column) -> Column:
    """Runs of characters that file names can't hold become one '_'; dots and spaces at the end go."""
    return F.regexp_replace(F.regexp_replace(name, _RUNS, "_"), _TAIL, "")


def json_quoted(value: Column) -> Column:
    """A string as JSON writes it, with letters beyond ASCII as they are."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}), r'(?s)\A\{"v":(.*)\}\z', 1)


#: What a '$' and a second character stand for in a value that is put in.
_PATTERN = r"\$[$&`']"


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: expressions that use it several times stay small."""
    return F.element_at(F.transform(F.array(value), lambda bound: body(bound)), 1)


def _patterned(parts: Column, key: str, value: Column) -> Column:
    """parts joined by value, whose '$' patterns give '$', the key, and what is before or after the place."""
    between, marks = F.split(value, _PATTERN, -1), F.regexp_extract_all(value, F.lit(f"({_PATTERN})"), 1)

    def put(place: Column) -> Column:
        before, after = F.array_join(F.slice(parts, F.lit(1), place), key), F.array_join(F.slice(parts, place + 1, F.size(parts)), key)
        given = F.transform(marks, lambda m: F.when(m == "$$", "$").when(m == "$&", key).when(m == "$`", before).otherwise(after))
        return F.array_join(F.zip_with(between, given, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return F.array_join(F.transform(parts, lambda part, k: F.when(k == 0, part).otherwise(F.concat(put(k), part))), "")


def render(template: Column | str, variables: Sequence[tuple[str, Column]], quoted: bool = False) -> Column:
    """Put values into {{names}}, one name after another: what one value puts in is seen by the names after it.

    Null gives ''.  In a value '$$' gives '$', '$&' the name in its braces, "$`" and "$'" the text before and after the
    place.  Rows without such a value take plain replacements.  quoted: values are put in as JSON strings.
    """
    plain = exact = F.lit(template) if isinstance(template, str) else template
    special = F.lit(False)
    for name, value in variables:
        text, key = F.when(value.isNull(), F.lit("")).otherwise(json_quoted(value) if quoted else value), f"{{{{{name}}}}}"
        special = special | text.rlike(_PATTERN)
        plain = F.replace(plain, F.lit(key), text)
        exact = _bound(F.split(exact, r"\Q" + key + r"\E", -1), lambda parts, key=key, text=text: _patterned(parts, key, text))
    return F.when(special, exact).otherwise(plain)


def put_in(template: str, name: str, value: str) -> str:
    """One name's replacement with all four '$' patterns."""
    key, out, at = f"{{{{{name}}}}}", [], 0
    while (hit := template.find(key, at)) >= 0:
        out.append(template[at:hit])
        k = 0
        while k < len(value):
            pair = value[k : k + 2]
            special = {"$$": "$", "$&": key, "$`": template[:hit], "$'": template[hit + len(key) :]}.get(pair)
            out.append(value[k] if special is None else special)
            k += 1 if special is None else 2
        at = hit + len(key)
    return "".join(out) + template[at:]


def normal_headings(text: Column) -> Column:
    """Without any first-level heading, all headings move up by what the first of them lacks to the first level."""
    depth = F.length(F.regexp_extract(text, r"(?m)^(#{1,6}) ", 1)) - 1
    moved = F.array_join(
        F.transform(
            F.split(text, "\n", -1),
            lambda line: F.when(
                line.rlike(r"^#{1,6} "),
                F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.length(F.regexp_extract(line, r"^(#{1,6}) ", 1)) - depth)), F.regexp_replace(line, r"^#{1,6}", "")),
            ).otherwise(line),
        ),
        "\n",
    )
    return F.when(text.rlike(r"(?m)^# ") | (depth < 0), text).otherwise(moved)


def utf16_length(text: Column) -> Column:
    """Code units of UTF-16: characters beyond the basic plane count twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def html_title(html: Column) -> Column:
    """The text of the first <title>, with white space collapsed; '' without one.  Entities stay as written."""
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]+>", "")


def url_path(url: Column) -> Column:
    return F.split(url, "#")[0]


def url_fragment(url: Column) -> Column:
    """Between the first '#' and the next; '' without one."""
    return F.coalesce(F.try_element_at(F.split(url, "#"), F.lit(2)), F.lit(""))


def is_html_path(path: Column) -> Column:
    return F.coalesce(path.rlike(r"(?i)\.(htm|html|xhtml)\z"), F.lit(False))


def rounded(scroll: Column) -> Column:
    """Reading positions keep four decimals."""
    return F.round(scroll, 4)

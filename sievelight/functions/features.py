"""Rule-based features of code chunks, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelight.functions.text import lines, occurrences, ordered_distinct, strip

#: A tag and the strings of which any gives it, in order.
RISK_RULES = [
    ("unsafe", ["unsafe"]),
    ("raw_ptr", ["*const", "*mut", "as *const", "as *mut"]),
    ("manual_mem", ["malloc", "free"]),
    ("memcpy_memmove", ["memcpy", "memmove"]),
    ("ptr_arith", [".add(", ".offset(", "wrapping_add", "wrapping_sub"]),
]
#: API names that are their own tags, in order.
API_NAMES = ["Vec", "Box", "copy_from_slice", "ptr::copy", "ptr::copy_nonoverlapping", "malloc", "free", "memcpy", "memmove"]
#: What a risk tag weighs.
RISK_WEIGHTS = {"unsafe": 3, "raw_ptr": 3, "ptr_arith": 2, "manual_mem": 2, "memcpy_memmove": 2}
#: How a function's first line begins.
SIGNATURE_STARTS = ["fn ", "pub fn ", "pub(crate) fn ", "pub(crate) unsafe fn ", "unsafe fn "]
#: Words before a parenthesis that aren't calls.
NOT_CALLS = ["fn", "if", "for", "while", "match", "loop", "return", "unsafe", "let", "pub", "mod", "struct", "enum", "impl", "use"]
#: What marks a risky line.
RISK_MARKS = ["unsafe", "*const", "*mut", "as *const", "as *mut", "malloc", "free", "memcpy", "memmove", ".add(", ".offset("]
#: Kinds of evidence that are their own type.
OWN_TYPES = ["rust_rule_snippet", "rust_idiom_template", "replacement_strategy", "interface_constraint", "behavior_constraint", "c_source_summary", "c_build_info", "c_symbol_summary"]
#: Strings counted by the safety report.
SAFETY = {"unsafe_blocks": ["unsafe"], "raw_ptr_count": ["*const", "*mut", "as *const", "as *mut"], "unsafe_api_count": ["malloc", "free", "memcpy", "memmove"]}


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def contains_any(text: Column, marks: list[str]) -> Column:
    return any_of([text.contains(m) for m in marks])


def risk_tags(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(contains_any(text, marks), tag) for tag, marks in RISK_RULES)))


def api_tags(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(text.contains(name), name) for name in API_NAMES)))


def _begins(line: Column) -> Column:
    return line.contains("fn ") & any_of([line.startswith(s) for s in SIGNATURE_STARTS])


def signature(text: Column, first: int = 30) -> Column:
    """The first signature line among the first lines, up to its brace; null if none."""
    found = F.filter(F.transform(F.slice(lines(text), 1, first), strip), _begins)
    return strip(F.split_part(F.get(found, F.lit(0)), F.lit("{"), F.lit(1)))


def calls(text: Column, hits: int = 40, most: int = 20) -> Column:
    """Called names: of the first hits that aren't keywords the distinct ones, the first few."""
    names = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\b([A-Za-z_]\w*)\s*\("), 1)
    named = F.filter(names, lambda n: ~n.isin(*NOT_CALLS))
    return F.slice(ordered_distinct(F.slice(named, 1, hits)), 1, most)


def risk_score(tags: Column) -> Column:
    """Sum of the tags' weights; a tag that occurs twice counts twice, an unknown one nothing."""
    table = F.create_map(*(F.lit(x) for kv in RISK_WEIGHTS.items() for x in kv))
    return F.coalesce(F.aggregate(tags, F.lit(0), lambda a, t: a + F.coalesce(F.element_at(table, strip(t)), F.lit(0))), F.lit(0))


def evidence_type(kind: Column, explicit: Column) -> Column:
    return F.when(strip(explicit) != "", explicit).when(kind == "rust_function_slice", "code_slice").when(kind.isin(*OWN_TYPES), kind).otherwise("code")


def safety_counts(text: Column) -> dict[str, Column]:
    """Counts by substring; a mark inside another counts for both."""
    return {name: reduce(lambda a, b: a + b, [occurrences(text, m) for m in marks]) for name, marks in SAFETY.items()}


def source_measures(text: Column) -> dict[str, Column]:
    own = lines(text)
    return {
        "unsafe_blocks": F.regexp_count(text, F.lit(r"\bunsafe\s*\{")).cast("long"),
        "raw_ptr_count": F.regexp_count(text, F.lit(r"\*const\b|\*mut\b|\bas\s+\*const\b|\bas\s+\*mut\b")).cast("long"),
        "unsafe_lines": F.size(F.filter(own, lambda x: x.contains("unsafe"))).cast("long"),
        "total_lines": F.size(own).cast("long"),
    }


def boundary(text: Column, reach: int = 8) -> dict[str, Column]:
    """The lines that a patch may touch: around the first risky line, else the first signature, else the first line."""
    own = lines(text)
    risk = F.array_position(F.transform(own, lambda x: contains_any(x, RISK_MARKS)), F.lit(True)).cast("int")
    sign = F.array_position(F.transform(own, lambda x: _begins(strip(x))), F.lit(True)).cast("int")
    none = F.lit(0)
    anchor = F.when(risk > none, risk).when(sign > none, sign).otherwise(1)
    return {
        "start_line": F.greatest(F.lit(1), anchor - reach),
        "end_line": F.least(F.greatest(F.size(own), F.lit(1)), anchor + reach),
        "anchor_line": anchor,
        "anchor_kind": F.when(risk > none, "risk").when(sign > none, "signature").otherwise("start"),
        "signature_line": F.when(sign > none, sign),
    }

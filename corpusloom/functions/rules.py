"""Rule classification: reason codes, priority routes, negation-aware concepts, closed sets.

Rules are data (lexicons and patterns given by the caller); the operators know their order of
precedence only.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusloom.functions.text import contains_any, delete_phrases, matches_any, split_clauses


def reasons(rules: Sequence[tuple[str, Column]]) -> Column:
    """Codes of all rules that hold, in rule order, each once; a null condition does not hold."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in rules])))


def primary(codes: Column) -> Column:
    return F.get(codes, F.lit(0))


def priority(rules: Sequence[tuple[str, Column]], default: str | None = None) -> Column:
    """Code of the first rule that holds."""
    out = F.when(rules[0][1], F.lit(rules[0][0]))
    for code, cond in rules[1:]:
        out = out.when(cond, F.lit(code))
    return out if default is None else out.otherwise(F.lit(default))


def topical(text: Column, terms: Sequence[str], unless: Sequence[str]) -> Column:
    """Has a term of one list and none of another (a documentary query, say)."""
    return contains_any(text, terms) & ~contains_any(text, unless)


def one_clause_has_both(text: Column, left: Sequence[str], right: Sequence[str]) -> Column:
    """Some single clause has a term of each list."""
    return F.exists(split_clauses(text), lambda c: contains_any(c, left) & contains_any(c, right))


def residual(clause: Column, allowed: Sequence[tuple[Column, Sequence[str]]]) -> Column:
    """The clause without the allowed terms of each role that applies, in list order."""
    for applies, terms in allowed:
        clause = F.when(applies, delete_phrases(clause, terms)).otherwise(clause)
    return clause


def only_roles(text: Column, roles: Mapping[str, Sequence[str]], blocked: Sequence[str], allowed: Mapping[str, Sequence[str]]) -> Column:
    """Every clause plays a role, and no blocked term is left once each role's allowed terms are deleted."""
    clauses = split_clauses(text)
    plays = {name: (lambda c, t=terms: contains_any(c, t)) for name, terms in roles.items()}

    def fine(c: Column) -> Column:
        any_role = F.lit(False)
        for test in plays.values():
            any_role = any_role | test(c)
        rest = residual(c, [(plays[name](c), allowed.get(name, ())) for name in plays])
        return any_role & ~contains_any(rest, blocked)

    return (F.size(clauses) > 0) & F.forall(clauses, fine)


def concept_state(text: str | None, positive: Sequence[re.Pattern], negative: Sequence[re.Pattern]) -> str:
    """present, absent or unknown: the last mention counts; a positive one inside a negative span does not.

    At the same start the positive mention counts.
    """
    if not text:
        return "unknown"
    denied = [m.span() for p in negative for m in p.finditer(text)]
    said = [m.span() for p in positive for m in p.finditer(text)]
    said = [s for s in said if not any(a <= s[0] and s[1] <= b for a, b in denied)]
    events = [(a, 0) for a, _ in denied] + [(a, 1) for a, _ in said]
    return "unknown" if not events else "present" if max(events)[1] else "absent"


def concept_states(concepts: Mapping[str, tuple[Sequence[str], Sequence[str]]]):
    """Pandas UDF: text -> struct of the state of every concept {name: (positive patterns, negative patterns)}."""
    compiled = {k: ([re.compile(p) for p in pos], [re.compile(p) for p in neg]) for k, (pos, neg) in concepts.items()}

    @F.pandas_udf(StructType([StructField(k, StringType()) for k in concepts]))
    def states(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({k: [concept_state(t, *v) for t in text] for k, v in compiled.items()}, index=text.index)

    return states


#: A small set of warning concepts as an example: positive and negative patterns.
WARNING_CONCEPTS = {
    "chest_pain": (["胸(?:口|前|部)?.{0,6}(?:疼|痛)"], ["(?:没有|无|没|不)(?:.{0,3})胸(?:口|前|部)?.{0,4}(?:疼|痛)"]),
    "dyspnea": (["呼吸.{0,4}(?:困难|费劲|费力)|喘不上|上不来气|气短"], ["(?:没有|无|没|不).{0,3}(?:呼吸.{0,3}(?:困难|费劲)|气短)"]),
    "severe_dyspnea": (["呼吸极度困难|几乎喘不上|完全喘不上"], []),
    "hematemesis": (["(?:呕|吐)[^，。；]{0,7}血"], ["(?:没有|无|没|不).{0,3}(?:呕|吐)血"]),
    "fatigue": (["疲倦|乏力|疲劳|没力气|总觉得累"], ["(?:没有|无|没|不).{0,2}(?:疲倦|乏力|疲劳)"]),
    "weight_loss": (["体重.{0,5}(?:下降|减轻)"], ["(?:没有|无|没).{0,3}体重.{0,3}(?:下降|减轻)"]),
    "palpitation": (["心慌|心悸"], ["(?:没有|无|没|不).{0,2}(?:心慌|心悸)"]),
    "dizziness": (["头晕|眩晕"], ["(?:没有|无|没|不).{0,2}(?:头晕|眩晕)"]),
}


def warning_route(state: Column) -> Column:
    """urgent or refer by the first rule that holds over concept states; null without one."""

    def has(name: str) -> Column:
        return state[name] == "present"

    return priority([("urgent", has("chest_pain") & has("dyspnea")), ("urgent", has("severe_dyspnea")), ("urgent", has("hematemesis")), ("refer", has("fatigue") & has("weight_loss")), ("refer", has("palpitation") & has("dizziness"))])


def suffix_entity(text: Column, suffixes: Sequence[str], anywhere: bool) -> Column:
    """Ends with, or (``anywhere``) contains, an entity suffix."""
    if anywhere:
        return contains_any(text, suffixes)
    return text.rlike(f"(?:{'|'.join(map(re.escape, suffixes))})$")


def beyond_closed_set(text: Column, counts: Mapping[str, int]) -> Column:
    """Asks for the n-th member of a closed set that has fewer."""
    from corpusloom.functions.text import small_chinese_number

    out = F.lit(False)
    for name, known in counts.items():
        n = small_chinese_number(F.regexp_extract(text, f"第([0-9]{{1,2}}|[一二三四五六七八九十两]{{1,3}})(?:个|种|条)?{name}", 1))
        out = out | F.coalesce(n > known, F.lit(False))
    return out


def slots_of(clause: Column, lexicon: Mapping[str, Sequence[str]]) -> Column:
    """Names of the slots whose terms occur in a clause."""
    return F.array_compact(F.array(*[F.when(contains_any(clause, terms), F.lit(name)) for name, terms in lexicon.items()]))


def bind_slot(clause: Column, lexicon: Mapping[str, Sequence[str]], pending: Column) -> Column:
    """The pending slot that a clause answers, if it is exactly one."""
    found = F.array_intersect(slots_of(clause, lexicon), pending)
    return F.when(F.size(found) == 1, found[0])


#: Answers that tell nothing.
UNKNOWN_ANSWERS = ("不知道", "不清楚", "不晓得", "不会看", "没看", "没有看", "没注意", "没有注意", "说不清", "不确定")


def unknown_answer(text: Column) -> Column:
    return contains_any(text, UNKNOWN_ANSWERS)


def request_error(text: Column, request_id: Column, state_bytes: Column, turn_count: Column, longest: int = 4096, most_bytes: int = 256 * 1024, most_turns: int = 24) -> Column:
    """First violation of the limits of a request; null if it is fine."""
    blank = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n　")) == ""
    return priority([("blank_text", blank), ("text_too_long", F.length(text) > longest), ("bad_request_id", request_id.isNotNull() & ~request_id.rlike(r"^[A-Za-z0-9._:-]{1,128}$")), ("state_too_large", state_bytes > most_bytes), ("too_many_turns", turn_count >= most_turns)])


def normalized_level(raw: Column, keys: Sequence[str] = ("level", "safety", "risk", "status", "action")) -> Column:
    """A level given as a string, or under one of several keys of an object; lower, stripped, '' becomes null."""
    found = F.coalesce(*[F.get_json_object(raw, f"$.{k}") for k in keys], F.when(~raw.rlike(r"^\s*[\[{]"), raw))
    return F.nullif(F.lower(F.trim(found)), F.lit(""))


def pattern_names(text: Column, patterns: Mapping[str, str]) -> Column:
    """Names of the patterns that match, in order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in patterns.items()]))


def any_risk(text: Column, patterns: Sequence[str]) -> Column:
    return matches_any(text, patterns)

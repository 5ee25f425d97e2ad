"""Functions on conversations: arrays of (from, value) turns; prompts, pairs, loss masks, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import SPACES

ROLES = ("system", "human", "gpt")


def values_of(turns: Column, role: str) -> Column:
    return F.transform(F.filter(turns, lambda t: t["from"] == role), lambda t: t["value"])


def first_value(turns: Column, role: str) -> Column:
    return F.get(values_of(turns, role), F.lit(0))


def last_value(turns: Column, role: str) -> Column:
    return F.try_element_at(values_of(turns, role), F.lit(-1))


def human_text(turns: Column, joint: str = " [下一轮] ") -> Column:
    """All human turns joined; '' without one."""
    return F.array_join(values_of(turns, "human"), joint)


def normalize_turns(turns: Column) -> Column:
    """Turns of known roles with stripped, nonblank values."""
    kept = F.filter(turns, lambda t: t["from"].isin(*ROLES) & (F.btrim(F.coalesce(t["value"], F.lit("")), F.lit(SPACES)) != ""))
    return F.transform(kept, lambda t: F.struct(t["from"].alias("from"), F.btrim(t["value"], F.lit(SPACES)).alias("value")))


def alternating(turns: Column) -> Column:
    """From the first human turn on, turns that alternate human and gpt; mismatches are skipped."""
    start = F.struct(F.lit("human").alias("want"), F.filter(turns, lambda t: F.lit(False)).alias("out"))

    def step(acc: Column, t: Column) -> Column:
        fits = t["from"] == acc["want"]
        other = F.when(acc["want"] == "human", "gpt").otherwise("human")
        return F.struct(F.when(fits, other).otherwise(acc["want"]).alias("want"), F.when(fits, F.array_append(acc["out"], t)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(turns, start, step, lambda acc: acc["out"])


def eval_sample(turns: Column) -> Column:
    """(system, history, target) of normalized turns; null unless the alternation ends with an answer."""
    clean = normalize_turns(turns)
    pairs = alternating(clean)
    system = F.when(F.get(clean, F.lit(0))["from"] == "system", F.get(clean, F.lit(0))["value"])
    n = F.size(pairs)
    whole = (n >= 2) & (n % 2 == 0)
    return F.when(whole, F.struct(system.alias("system"), F.slice(pairs, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("history"), F.try_element_at(pairs, F.lit(-1))["value"].alias("target")))


def dialog_pairs(turns: Column) -> Column:
    """Training dialog by position: after an optional system turn, even turns human, odd gpt.

    An unknown role ends the dialog, a turn of the wrong parity is skipped, an odd rest or fewer than
    two turns gives null.
    """
    head = F.get(turns, F.lit(0))["from"] == "system"
    body = F.when(head, F.slice(turns, 2, F.size(turns))).otherwise(turns)
    start = F.struct(F.lit(False).alias("ended"), F.lit(0).alias("i"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        ended = acc["ended"] | ~t["from"].isin("human", "gpt") | t["from"].isNull()
        wanted = F.when(acc["i"] % 2 == 0, "human").otherwise("gpt")
        take = ~ended & (t["from"] == wanted)
        return F.struct(ended.alias("ended"), (acc["i"] + 1).alias("i"), F.when(take, F.array_append(acc["out"], t["value"])).otherwise(acc["out"]).alias("out"))

    out = F.aggregate(body, start, step, lambda acc: acc["out"])
    return F.when((F.size(turns) >= 2) & (F.size(out) >= 2) & (F.size(out) % 2 == 0), out)


# Separators and frames of public chat templates.
TEMPLATES = {
    "vicuna": {"system": "A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions.", "prompt": "USER: {query} ASSISTANT:", "sep": "</s>", "after_system": " "},
    "alpaca": {"system": "Below is an instruction that describes a task. Write a response that appropriately completes the request.", "prompt": "### Instruction:\n{query}\n\n### Response:\n", "sep": "\n\n", "after_system": "\n\n"},
    "qwen": {"system": "<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n", "prompt": "<|im_start|>user\n{query}<|im_end|>\n<|im_start|>assistant\n", "sep": "<|im_end|>\n", "after_system": ""},
    "plain": {"system": "", "prompt": "{query}", "sep": "\n", "after_system": ""},
}


def register_template(name: str, prompt: str, sep: str = "\n", system: str = "", after_system: str = "") -> None:
    TEMPLATES[name] = {"system": system, "prompt": prompt, "sep": sep, "after_system": after_system}


def render(dialog: Column, template: str = "vicuna", system: Column | None = None) -> Column:
    """Prompt text of alternating values: the system text before the first query, the separator after each answer."""
    t = TEMPLATES[template]
    before, after = t["prompt"].split("{query}")
    lead = F.coalesce(system, F.lit(t["system"])) if system is not None else F.lit(t["system"])
    body = F.array_join(F.transform(dialog, lambda v, i: F.when(i % 2 == 0, F.concat(F.lit(before), v, F.lit(after))).otherwise(F.concat(v, F.lit(t["sep"])))), "")
    return F.concat(lead, F.when(lead != "", F.lit(t["after_system"])).otherwise(F.lit("")), body)


def alpaca_conversation(instruction: Column, extra: Column, output: Column) -> Column:
    """Instruction, blank line and nonblank input as the human turn."""
    query = F.when(F.btrim(F.coalesce(extra, F.lit("")), F.lit(SPACES)) != "", F.concat_ws("\n\n", instruction, extra)).otherwise(instruction)
    return F.array(F.struct(F.lit("human").alias("from"), query.alias("value")), F.struct(F.lit("gpt").alias("from"), output.alias("value")))


def preference_row(system: Column, history: Column, question: Column, chosen: Column, rejected: Column, template: str = "vicuna") -> Column:
    """(prompt, chosen, rejected) of a preference pair."""
    dialog = F.concat(F.flatten(history), F.array(question))
    return F.struct(render(dialog, template, system).alias("prompt"), chosen.alias("chosen"), rejected.alias("rejected"))


def rl_prompt(system: str, question: Column) -> Column:
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(message("system", F.lit(system)), message("user", question))


def blanked_history(turns: Column) -> Column:
    """The turns with the last value blank."""
    return F.transform(turns, lambda t, i: F.struct(t["from"].alias("from"), F.when(i + 1 == F.size(turns), F.lit("")).otherwise(t["value"]).alias("value")))


def masked_example(source: Column, target: Column, longest: int, end: int, ignore: int = -100) -> Column:
    """(input_ids, labels): source and target ids cut in proportion to fit, source labels ignored, end appended to the target."""
    s, t = F.size(source), F.size(target)
    total = F.greatest(s + t, F.lit(1))
    most_s, most_t = F.floor(F.lit(longest) * s / total).cast("int"), F.floor(F.lit(longest) * t / total).cast("int")
    src = F.slice(source, F.lit(1), F.greatest(F.least(s, most_s), F.lit(0)))
    tgt = F.slice(target, F.lit(1), F.greatest(F.least(t, most_t - 1), F.lit(0)))
    ids = F.concat(src, tgt, F.array(F.lit(end)))
    labels = F.concat(F.transform(src, lambda _: F.lit(ignore)), tgt, F.array(F.lit(end)))
    return F.struct(ids.alias("input_ids"), labels.alias("labels"))


def pad_right(ids: Column, width: Column, pad: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(width - F.size(ids), F.lit(0))))


def pack_blocks(rows: DataFrame, batch: str, order: str, ids: str, block: int) -> DataFrame:
    """batch, block, ids: the tokens of each batch joined in order and cut into blocks; the rest is dropped unless it is all there is.

    Tokens find their block by a running offset, so rows of a batch meet in no task as a whole: only
    the tokens of one block are gathered.
    """
    size = F.size(ids)
    before = F.coalesce(F.sum(size).over(Window.partitionBy(batch).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(size).over(Window.partitionBy(batch))
    at = rows.select(batch, F.col(ids).alias("_ids"), before.alias("_before"), total.alias("_total"))
    parts = at.select(batch, "_total", "_before", "_ids", F.explode(F.sequence(F.floor(F.col("_before") / block), F.floor((F.col("_before") + F.greatest(F.size("_ids"), F.lit(1)) - 1) / block))).alias("block"))
    low = F.greatest(F.col("block") * block, F.col("_before"))
    high = F.least((F.col("block") + 1) * block, F.col("_before") + F.size("_ids"))
    cut = parts.where("size(_ids) > 0").select(batch, "block", "_total", low.alias("_low"), F.slice("_ids", (low - F.col("_before") + 1).cast("int"), (high - low).cast("int")).alias("_cut"))
    whole = cut.groupBy(batch, "block", "_total").agg(F.array_sort(F.collect_list(F.struct("_low", "_cut"))).alias("_parts"))  # at most ``block`` tokens
    joined = whole.select(batch, "block", "_total", F.flatten(F.transform("_parts", lambda p: p["_cut"])).alias("ids"))
    return joined.where((F.size("ids") == block) | (F.col("_total") < block)).select(batch, "block", "ids")


def turn_error(turns: Column) -> Column:
    """First reason why turns are not exactly one nonblank human and gpt pair; null if they are."""
    a, b = F.get(turns, F.lit(0)), F.get(turns, F.lit(1))

    def blank(t: Column) -> Column:
        return F.btrim(F.coalesce(t["value"], F.lit("")), F.lit(SPACES)) == ""

    return F.when(turns.isNull(), "missing").when(F.size(turns) != 2, "count").when((a["from"] != "human") | (b["from"] != "gpt"), "roles").when(blank(a) | blank(b), "blank")


def valid_turns(turns: Column) -> Column:
    """Every turn has a known role and a value, and there is one."""
    return F.coalesce((F.size(turns) > 0) & F.forall(turns, lambda t: t["from"].isin(*ROLES) & t["value"].isNotNull()), F.lit(False))


def flat_to_nested(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """One row per conversation from one row per turn; a conversation has a bounded number of turns."""
    names = F.when(F.col(role) == "user", "human").when(F.col(role) == "assistant", "gpt").otherwise(F.col(role))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), names.alias("from"), F.col(text).alias("value"))))
    return rows.groupBy(key).agg(ordered.alias("_t")).select(key, F.transform("_t", lambda t: F.struct(t["from"].alias("from"), t["value"].alias("value"))).alias("conversations"))

"""From any labelled frame to (domain, user_prompt, assistant_text, label, source_path)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from probewise.config import (
    ANSWER_COLUMNS, CLAIM_PAIR_PROMPT, DEFAULT_PROMPT, ETHICAL_PROMPT, ETHICAL_PROMPT_COLUMNS,
    LONG_TEXT_LENGTH, NOT_LONG_TEXT_COLUMNS, PROMPT_COLUMNS)
from probewise.functions.cells import Cells, dict_columns, strip
from probewise.functions.labels import label as label_rule, label_parts


def _as_column(value: str | Column) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def default_prompt(domain: Column, cells: Cells) -> Column:
    action = cells.first(ETHICAL_PROMPT_COLUMNS)["text"]
    return F.when(domain == "ethical", F.coalesce(action, F.lit(ETHICAL_PROMPT))).otherwise(F.lit(DEFAULT_PROMPT))


def message_text(messages: Column, role: str) -> tuple[Column, Column]:
    """First message of a role: (is there one, its content)."""
    of_role = F.filter(messages, lambda m: m["role"] == role)
    return F.coalesce(F.size(of_role) > 0, F.lit(False)), F.get(of_role, F.lit(0))["content"]


def spoken_by(cells: Cells, role: str) -> tuple[Column, Column] | None:
    """First message of a role in a row's chat, typed or spelled out; None if no row can have one."""
    typed, spelled = cells.messages(), None if "messages" in cells.top else cells[f"messages/{role}"]
    parts = [message_text(typed, role)] if typed is not None else []
    if spelled is not None:
        parts.append((spelled.isNotNull(), spelled["text"]))
    if not parts:
        return None
    there, said = parts[0]
    for more, text in parts[1:]:
        there, said = there | more, F.when(there, said).otherwise(text)
    return there, said


def normalize(df: DataFrame, domain: str | Column, source_path: str | Column,
              literal_columns: Sequence[str | tuple[str, ...]] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Normalised examples of a raw frame; rows without text or label are dropped.

    ``literal_columns`` names text columns whose values may spell dictionaries; when
    not given they are looked for in one pass. ``keep`` carries columns through.
    """
    found = dict_columns(df) if literal_columns is None else literal_columns
    cells = Cells(df, found)
    domain, source_path = _as_column(domain), _as_column(source_path)
    answer = cells.first(ANSWER_COLUMNS)["text"]
    prompt = cells.first(PROMPT_COLUMNS)["text"]
    replied, asked = spoken_by(cells, "assistant"), spoken_by(cells, "user")
    if asked is not None:
        prompt = F.when(answer.isNull() & asked[0], asked[1]).otherwise(prompt)
    if replied is not None:
        answer = F.coalesce(answer, F.when(*replied))
    answer = F.coalesce(answer, cells.long_text(LONG_TEXT_LENGTH, NOT_LONG_TEXT_COLUMNS))
    # Values used several times become columns, so that no rule is worked out twice.
    source = cells.df.withColumns({"_answer": answer, "_prompt": prompt, **label_parts(cells)})
    answer, prompt = F.col("_answer"), F.col("_prompt")
    repeated = prompt.isNull() | (strip(prompt) == strip(answer))
    prompt = F.when(repeated, default_prompt(domain, cells)).otherwise(prompt)

    def example(user_prompt: Column, text: Column, y: Column) -> Column:
        return F.struct(user_prompt.alias("user_prompt"), text.alias("assistant_text"),
                        y.cast("int").alias("label"))

    single = example(prompt, answer, label_rule(F.col("_value"), F.col("_truth"), F.col("_is_true")))
    claim, negated = cells["Claim"], cells["Negated Claim"]
    if claim is not None and negated is not None:
        def spelled(c: Column) -> Column:
            return F.coalesce(c["text"], F.lit("nan"))
        pair = F.array(example(F.lit(CLAIM_PAIR_PROMPT), spelled(claim), F.lit(0)),
                       example(F.lit(CLAIM_PAIR_PROMPT), spelled(negated), F.lit(1)))
        paired = claim.isNotNull() & negated.isNotNull()
        single = F.explode(F.when(paired, pair).otherwise(F.array(single)))
    rows = source.select(
        *keep, domain.alias("domain"), source_path.alias("source_path"), single.alias("_e"))
    rows = rows.select(*keep, "domain", "_e.user_prompt", "_e.assistant_text", "_e.label", "source_path")
    return rows.filter(F.col("assistant_text").isNotNull() & F.col("label").isin(0, 1))


def normalize_or_fail(df: DataFrame, domain: str, source_path: str, **options) -> DataFrame:
    """As ``normalize``; a frame without any usable row is an error."""
    out = normalize(df, domain, source_path, **options)
    if out.isEmpty():
        raise ValueError(f"{source_path} holds no row with both a text and a label")
    return out


def chat_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, user_prompt, assistant_text) from one row per turn: the first of each role.

    A conversation without an assistant turn has no answer and is left out.
    """
    first = {role: F.min_by(F.when(F.col("role") == role, F.col("text")),
                            F.when(F.col("role") == role, F.col("turn"))) for role in ("user", "assistant")}
    return turns.filter(F.col("role").isin("user", "assistant")).groupBy("conv_id").agg(
        first["user"].alias("user_prompt"), first["assistant"].alias("assistant_text"),
    ).filter(F.col("assistant_text").isNotNull())

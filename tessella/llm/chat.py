"""Preference formatting of conversations: one prompt, two masked completions.

For a chosen and a rejected conversation the longest common prefix of turns (equal role and text) is rendered
once as the prompt; what follows in each is its completion. A turn renders as ``<|role|>``, newline, text,
``<|end|>``, newline. A completion comes with the spans, in code points, that a model is to learn from: the
texts of assistant turns with their end marks. All else (prompt, headers, other roles) is masked.

Null roles and texts count as empty, null conversations as conversations without turns, turns with a null
conv_id are left out. Turns with one number follow each other by role, then text; repeated rows are turns
of their own. Equal conversations give two empty completions. An empty table gives no rows; other columns
play no part. A conversation is one row of the result, so its turns meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.session import small_batches
from tessella.llm.subwords import encoder

LEARNED = "assistant"
END = "<|end|>"
TURNS = "array<struct<role: string, text: string>>"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns (role, text in order) from rows (conv_id, turn, role, text)."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), empty("role").alias("role"), empty("text").alias("text"))
    kept = turns.filter("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return kept.select("conv_id", F.expr("transform(turns, x -> struct(x.role as role, x.text as text))").alias("turns"))


def common_turns(a: str, b: str) -> Column:
    """Number of leading turns that the columns a and b have in common."""
    m = f"least(size({a}), size({b}))"
    same = f"zip_with(slice({a}, 1, {m}), slice({b}, 1, {m}), (x, y) -> x = y)"
    return F.expr(f"case array_position({same}, false) when 0 then {m} else array_position({same}, false) - 1 end").cast("int")


def _render(turns: str) -> str:
    return f"array_join(transform({turns}, x -> concat('<|', x.role, '|>\\n', x.text, '{END}\\n')), '')"


def _learned(turns: str) -> str:
    """SQL for the spans to learn from in the rendering of ``turns``."""
    head = "length(x.role) + 5"
    size = f"({head} + length(x.text) + {len(END) + 1})"
    span = f"array(struct(s.at + {head} as start, s.at + {head} + length(x.text) + {len(END)} as end))"
    empty = "cast(array() as array<struct<start: int, end: int>>)"
    step = f"named_struct('at', s.at + {size}, 'spans', case when x.role = '{LEARNED}' then concat(s.spans, {span}) else s.spans end)"
    return f"aggregate({turns}, named_struct('at', 0, 'spans', {empty}), (s, x) -> {step}, s -> s.spans)"


def preferences(pairs: DataFrame) -> DataFrame:
    """``pairs`` (chosen, rejected: arrays of role and text) with common_turns, prompt, and each side's completion and learned spans."""
    out = pairs.withColumns({c: F.coalesce(F.col(c), F.array().cast(TURNS)) for c in ("chosen", "rejected")})
    out = out.withColumn("common_turns", common_turns("chosen", "rejected"))
    rest = {c: f"slice({c}, common_turns + 1, size({c}))" for c in ("chosen", "rejected")}
    made = {"prompt": F.expr(_render("slice(chosen, 1, common_turns)"))}
    for c, turns in rest.items():
        made |= {f"{c}_completion": F.expr(_render(turns)), f"{c}_learned": F.expr(_learned(turns))}
    return out.withColumns(made)


def last_turn_pairs(turns: DataFrame) -> DataFrame:
    """conv_id, chosen, rejected: each conversation against itself with the last turn of its partner, conv_id XOR 1; without partner, without the last turn."""
    whole = conversations(turns)
    other = whole.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.slice("turns", -1, 1).alias("reply"))
    replaced = F.expr("concat(slice(turns, 1, size(turns) - 1), coalesce(reply, array()))")
    return whole.join(other, "conv_id", "left").select("conv_id", F.col("turns").alias("chosen"), replaced.alias("rejected"))


def digest(found: DataFrame) -> DataFrame:
    """Fixed-width columns of preferences(), for comparisons."""
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    sides = [x for c in ("chosen", "rejected") for x in (F.sha2(f"{c}_completion", 256).alias(f"{c}_sha256"), spans(f"{c}_learned").alias(f"{c}_learned"))]
    sizes = [F.size(c).cast("long").alias(f"{c}_turns") for c in ("chosen", "rejected")]
    return found.select("conv_id", *sizes, F.col("common_turns").cast("long").alias("common_turns"), F.sha2("prompt", 256).alias("prompt_sha256"), *sides)


def tokenized(found: DataFrame, tokenizer_path: str) -> DataFrame:
    """For preferences(): per side ids and mask (1 where to learn) of prompt and completion, encoded part by part."""
    small_batches(found.sparkSession)
    ints = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = encoder(tokenizer_path)
            columns = {"conv_id": batch.column("conv_id")}
            for side in ("chosen", "rejected"):
                ids, masks = [], []
                for prompt, text, spans in zip(*(batch.column(c).to_pylist() for c in ("prompt", f"{side}_completion", f"{side}_learned")), strict=True):
                    parts, learn, at = [prompt], [0], 0
                    for s in spans:
                        parts += [text[at : s["start"]], text[s["start"] : s["end"]]]
                        learn += [0, 1]
                        at = s["end"]
                    got, ends = e.encode(pa.array([*parts, text[at:]], pa.large_string()))
                    ids.append(got.astype(np.int32))
                    masks.append(np.repeat(np.array([*learn, 0], np.int32), np.diff(ends)))
                columns |= {f"{side}_ids": pa.array(ids, ints), f"{side}_mask": pa.array(masks, ints)}
            yield pa.RecordBatch.from_pydict(columns)

    sides = ", ".join(f"{c}_ids array<int>, {c}_mask array<int>" for c in ("chosen", "rejected"))
    return found.select("conv_id", "prompt", "chosen_completion", "chosen_learned", "rejected_completion", "rejected_learned").mapInArrow(run, f"conv_id long, {sides}")

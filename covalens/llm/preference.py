"""Preference formatting: the longest common turn prefix once, as prompt, and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _turn), "")


def _turn(t: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), t.role, F.lit("\n"), t.text, F.lit("<|im_end|>\n"))


def _mask(turns: Column) -> Column:
    """start:end of what is learned (the text and end mark of assistant turns), in code points of the completion."""
    # start and end of the learned stretch of each turn, and where the next turn begins
    step = lambda acc, t: F.struct(
        (acc.at + F.char_length(_turn(t))).alias("at"),
        F.when(t.role == "assistant", F.concat(acc.spans, F.array(F.concat_ws(":", acc.at + F.lit(13) + F.char_length(t.role), acc.at + F.char_length(_turn(t)) - 1)))).otherwise(acc.spans).alias("spans"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.array_join(F.aggregate(turns, zero, step, lambda acc: acc.spans), ",")


def _tidy(column: str) -> Column:
    """Null is empty, and marks inside a text are broken up so that none can be forged."""
    return F.replace(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation by turn, then role and text; null turns first."""
    t = F.struct(F.col("turn").cast("long").alias("turn"), _tidy("role").alias("role"), _tidy("text").alias("text"))
    got = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), t.alias("t"))
    got = got.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return got.select("conv_id", F.transform("turns", lambda x: F.struct(x.role.alias("role"), x.text.alias("text"))).alias("turns"))


def formatted(pairs: DataFrame) -> DataFrame:
    """pair_id, chosen_id, rejected_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask.

    ``pairs`` has pair_id, chosen_id, rejected_id and the arrays chosen_turns and
    rejected_turns of struct(role, text). Turns are equal if role and text are.
    The common prefix is rendered once; a completion is what follows it, empty
    if one conversation is a prefix of the other. A missing side has null id,
    completion and mask, and then nothing is common. Masks list start:end of the
    assistant's texts and end marks in code points of the completion; all else,
    the prompt included, is masked.
    """
    same = F.zip_with("chosen_turns", "rejected_turns", lambda a, b: a.eqNullSafe(b))
    differ = F.array_position(same, F.lit(False))
    both = F.col("chosen_turns").isNotNull() & F.col("rejected_turns").isNotNull()
    common_ = F.when(both, F.when(differ > 0, differ - 1).otherwise(F.size("chosen_turns"))).otherwise(0).cast("int")
    df = pairs.withColumn("n_common", common_)
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c), F.lit(1)))
    df = df.withColumns({"__c": rest("chosen_turns"), "__r": rest("rejected_turns")})
    prompt = F.coalesce(_rendered(F.slice("chosen_turns", F.lit(1), F.col("n_common"))), F.lit(""))
    return df.select("pair_id", "chosen_id", "rejected_id", F.col("n_common").cast("long").alias("n_common"), prompt.alias("prompt"), _rendered(F.col("__c")).alias("chosen"), _rendered(F.col("__r")).alias("rejected"), _mask(F.col("__c")).alias("chosen_mask"), _mask(F.col("__r")).alias("rejected_mask"))


def neighbouring_pairs(conversations: DataFrame) -> DataFrame:
    """Conversations 2i (chosen) and 2i + 1 (rejected) side by side; one without a partner stays alone.

    Rows of a null conv_id form one conversation, chosen in a pair of null pair_id.
    """
    got = turns_of(conversations)
    pair = F.floor(F.col("conv_id") / 2).cast("long")
    is_chosen = F.coalesce(F.pmod("conv_id", F.lit(2)) == 0, F.lit(True))
    pick = lambda c, yes: F.max(F.when(yes, F.col(c)))
    # each side is one row, so the larger of it and nulls is it
    return got.withColumn("pair_id", pair).groupBy("pair_id").agg(pick("conv_id", is_chosen).alias("chosen_id"), pick("conv_id", ~is_chosen).alias("rejected_id"), F.first(F.when(is_chosen, F.col("turns")), True).alias("chosen_turns"), F.first(F.when(~is_chosen, F.col("turns")), True).alias("rejected_turns"))


def preference_pairs(conversations: DataFrame) -> DataFrame:
    """``formatted`` over ``neighbouring_pairs``; takes conv_id, turn, role, text. An empty table gives no rows."""
    return formatted(neighbouring_pairs(conversations))


def _side(turns: str) -> str:
    at = f"len(list_aggregate(list_transform({turns}[n_common + 1 : i - 1], lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), 'string_agg', ''))"
    start = f"coalesce({at}, 0)"
    spans = f"""list_aggregate(list_transform(list_filter(range(n_common + 1, len({turns}) + 1), lambda i: {turns}[i].role = 'assistant'),
        lambda i: ({start} + 13 + len({turns}[i].role))::varchar || ':' || ({start} + 13 + len({turns}[i].role) + len({turns}[i].text) + 10)::varchar), 'string_agg', ',')"""
    return f"case when {turns} is not null then coalesce({spans}, '') end"


def _text(turns: str) -> str:
    return f"case when {turns} is not null then coalesce(list_aggregate(list_transform({turns}, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), 'string_agg', ''), '') end"


ORACLE = f"""
with c as (select conv_id, list({{'role': replace(coalesce(role, ''), '<|', '< |'), 'text': replace(coalesce(text, ''), '<|', '< |')}} order by turn nulls first, replace(coalesce(role, ''), '<|', '< |'), replace(coalesce(text, ''), '<|', '< |')) as turns
    from conversations group by conv_id),
p as (select cast(floor(conv_id / 2) as bigint) as pair_id,
        max(case when coalesce(conv_id % 2 = 0, true) then conv_id end) as chosen_id, max(case when conv_id % 2 <> 0 then conv_id end) as rejected_id,
        any_value(case when coalesce(conv_id % 2 = 0, true) then turns end) as a, any_value(case when conv_id % 2 <> 0 then turns end) as b
    from c group by 1),
n as (select *, case when a is null or b is null then 0
        else coalesce(list_min(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] is distinct from b[i])) - 1, len(a)) end as n_common from p)
select pair_id, chosen_id, rejected_id, cast(n_common as bigint) as n_common, coalesce({_text("a[1 : n_common]")}, '') as prompt,
    {_text("a[n_common + 1 :]")} as chosen, {_text("b[n_common + 1 :]")} as rejected, {_side("a")} as chosen_mask, {_side("b")} as rejected_mask
from n
"""

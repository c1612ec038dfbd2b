"""Chat formatting with Spark expressions only (operator 3)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

OPEN, CLOSE, PART = "<turn>", "</turn>\n", "<part>"
CHUNK = 256     # entries summed at a time
BLOCK = 1024    # characters of a block of formatted text


def escaped(text: Column) -> Column:
    """``text`` without any ``<``, so no control string of the template can stand in it; reversible."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def _unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\n"), F.lit("\n")))


def format_conversations(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (array of start, length in code points).

    :param turns: conv_id, turn, role, text; other columns are ignored.
    :param learn: role whose texts are under the loss mask.

    Turns stand by ``turn``; ties by role, then text; a null turn comes first. Adjacent turns of a role share one block,
    in which ``<part>`` keeps the texts apart. The output is read back exactly by :func:`parse`. A null text or role
    is empty. Repeated rows are repeated turns. A row without conv_id is a conversation of its own (with a null
    conv_id), as nothing says what it belongs to. No rows give no rows. The rows of one conversation meet in one
    task, since they become one text; the work grows with their number.
    """
    clean = turns.select(
        "conv_id", F.when(F.col("conv_id").isNull(), F.uuid()).alias("_lone"),
        F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("_t"))
    sorted_turns = clean.groupBy("conv_id", "_lone").agg(F.array_sort(F.collect_list("_t")).alias("_ts"))

    # each turn beside the role before it: a turn of another role opens a block
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform(F.slice("_ts", 1, F.size("_ts") - 1), lambda t: t["role"]))

    def piece(t: Column, role_before: Column) -> Column:
        opened = F.concat(F.lit(OPEN), _escaped_role(t["role"]), F.lit("\n"))
        lead = F.when(role_before.isNull(), opened).when(role_before == t["role"], F.lit(PART)).otherwise(F.concat(F.lit(CLOSE), opened))
        return F.struct(lead.alias("lead"), escaped(t["text"]).alias("text"), (t["role"] == learn).alias("learned"))

    pieces = sorted_turns.select("conv_id", F.zip_with("_ts", before, piece).alias("_ps"))
    ends = running_sums(F.transform("_ps", lambda p: F.length(p["lead"]) + F.length(p["text"])))
    spans = F.zip_with("_ps", ends, lambda p, end: F.struct(
        p["learned"].alias("learned"), (end - F.length(p["text"])).alias("start"), F.length(p["text"]).alias("length")))
    return pieces.select(
        "conv_id", F.concat(F.array_join(F.transform("_ps", lambda p: F.concat(p["lead"], p["text"])), ""), F.lit(CLOSE)).alias("formatted"),
        F.transform(F.filter(spans, lambda s: s["learned"]), lambda s: F.struct(s["start"], s["length"])).alias("loss_spans"))


def running_sums(values: Column) -> Column:
    """The sums up to each entry of an array of int. Sums inside chunks first, then those of the chunks before are added, as an array that
    grows is copied with every entry."""
    def sums(of: Column) -> Column:
        zero = F.array(F.lit(0))
        return F.aggregate(of, zero, lambda done, v: F.concat(done, F.array(F.element_at(done, -1) + v)))

    def chunked(of: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor(F.size(of) / CHUNK).cast("int")), lambda i: F.slice(of, i * CHUNK + 1, CHUNK))
        return F.transform(chunks, lambda chunk: F.slice(sums(chunk), 2, CHUNK))

    def shifted(inner: Column) -> Column:
        bases = F.slice(sums(F.transform(inner, lambda c: F.coalesce(F.try_element_at(c, F.lit(-1)), F.lit(0)))), 1, F.size(inner))
        return F.flatten(F.zip_with(inner, bases, lambda c, base: F.transform(c, lambda v: v + base)))

    return _once(_once(values, chunked), shifted)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` evaluated once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), one entry per turn."""
    blocks = F.split(formatted, CLOSE)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        role = _unescaped_role(F.substr(head, F.lit(len(OPEN) + 1)))
        return F.transform(F.split(F.substr(block, F.length(head) + 2), PART),
                           lambda text: F.struct(role.alias("role"), unescaped(text).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def under_mask(formatted: Column, loss_spans: Column) -> Column:
    """The texts under the loss mask, unescaped, one after the other.

    A span is cut from the blocks of characters it touches, as finding a place counts the characters before it.
    """
    def cut(blocks: Column) -> Column:
        def text(s: Column) -> Column:
            first = F.floor(s["start"] / BLOCK).cast("int")
            touched = F.floor((s["start"] + s["length"]) / BLOCK).cast("int") - first + 1
            return unescaped(F.substr(F.array_join(F.slice(blocks, first + 1, touched), ""), s["start"] - first * BLOCK + 1, s["length"]))

        return F.array_join(F.transform(loss_spans, text), "")

    return _once(F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), cut)

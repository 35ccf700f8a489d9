"""Chat formatting with a template taken as a black box.

Successive prefixes of the turns are rendered and consecutive outputs compared: what the longer one adds is the turn's
span. An output that doesn't start with the one before shows a template that rewrites history. Within a span, two
renderings with other texts in the turn's place show where its text begins and ends, and so what a loss mask covers.

Conversations stream through in order of their turns; one is held whole and rendered from its first turn on, so the cost
of its prefixes is quadratic in its length. ``block`` only cuts what is written.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import islice, pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (role, text) of the turns, and the number of turns before them -> output
Template = Callable[[list[tuple[str, str]], int], str]
OPEN, CLOSE = "<|turn|>", "<|end|>\n"


def escape(text: str) -> str:
    """No result holds ``<|``: a backslash doubles, and one goes between the two characters."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def default_template(turns: list[tuple[str, str]], before: int = 0) -> str:
    """Each turn as ``<|turn|>role\\n text <|end|>``, role and text escaped, a role's line breaks as ``\\n``."""
    return "".join(f"{OPEN}{escape(r).replace(chr(10), '<|n|>')}\n{escape(t)}{CLOSE}" for r, t in turns)


def parse(output: str) -> list[tuple[str, str]]:
    """The turns that default_template was given."""
    turns = []
    for part in output.split(OPEN)[1:]:
        role, _, text = part.removesuffix(CLOSE).partition("\n")
        turns.append((unescape(role.replace("<|n|>", "\n")), unescape(text)))
    return turns


class HistoryRewritten(ValueError):
    pass


def turn_spans(template: Template, turns: list[tuple[str, str]], before: int = 0) -> tuple[str, list[tuple[int, int, int, int]], list[int]]:
    """(output, [(start, end, text_start, text_end)] of each turn, turns whose rendering changed what stood before)."""
    out, spans, rewrites = template([], before), [], []
    for i, (role, text) in enumerate(turns):
        head = turns[:i]
        now = template([*head, (role, text)], before)
        if not now.startswith(out):
            rewrites.append(i)
        start = len(out) if now.startswith(out) else _common(out, now)
        a, b = template([*head, (role, "")], before), template([*head, (role, "")], before)
        left = _common(a, b)
        right = _common(a[left + 1 :][::-1], now[::-1])
        right = min(right, len(a) - left - 1)
        spans.append((start, len(now), left, len(now) - right))
        out = now
    return out, spans, rewrites


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


def _digest(conv: object, turns: list[tuple[str, str]], trained: set[str], template: Template) -> tuple:
    out, spans, rewrites = turn_spans(template, turns)
    turns_sha, loss, loss_sha = hashlib.sha256(), 0, hashlib.sha256()
    for (role, text), (_, _, lo, hi) in zip(parse(out), spans, strict=True):
        turns_sha.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if role in trained:
            seen = unescape(out[lo:hi])
            loss += len(seen)
            loss_sha.update(seen.encode("utf-8", "surrogatepass"))
    return (conv, len(turns), turns_sha.hexdigest(), loss, loss_sha.hexdigest(), len(out), len(rewrites))


def _conversations(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str | None, list[tuple[str, str]]]]:
    """(conv_id as text, turns), where rows come in order of the conversation."""
    now, held = None, []
    for b in batches:
        for c, r, t in zip(b["conv_id"], b["role"], b["text"], strict=True):
            c = None if pd.isna(c) else c
            if held and c != now:
                yield now, held
                held = []
            now = c
            held.append((r, t))
    if held:
        yield now, held


def _ordered(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    empty = F.lit("")
    rows = df.select(F.col(conv).cast("string").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_chats(df: DataFrame, template: Template = default_template, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = 32) -> DataFrame:
    """conv_id, block, formatted, turns: array<struct<start, end, text_start, text_end, role>>, rewrites: array<int>.

    One row for each ``block`` turns of a conversation; their ``formatted`` in order are the template's output for the
    whole of it. A turn's places, found in the prefix that ends with it, count from the start of its block, and
    ``rewrites`` from its first turn. Turns go by ``turn`` (null first), then role and text; rows that repeat stay. Null
    role and text count as empty; rows with a null id are one conversation. Ids are of any type that is read back from text. Other columns are not carried.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for conv_id, held in _conversations(batches):
            out, spans, rewrites = turn_spans(template, held)
            # A block starts where its first turn does, or where a later turn's change of history does.
            cuts, least = [len(out)], len(out)
            for lo in range((len(held) - 1) // block * block, -1, -block):
                least = min(least, *[s[0] for s in spans[lo : lo + block]])
                cuts.append(least if lo else 0)
            cuts.reverse()
            for k, (x, y) in enumerate(pairwise(cuts)):
                own = slice(k * block, (k + 1) * block)
                turns = [dict(zip(("start", "end", "text_start", "text_end", "role"), (*[v - x for v in s], r), strict=True)) for s, (r, _) in zip(spans[own], held[own], strict=True)]
                row = {"conv_id": [conv_id], "block": [k], "formatted": [out[x:y]], "turns": [turns], "rewrites": [[i - k * block for i in rewrites if i // block == k]]}
                yield pd.DataFrame(row).astype({"conv_id": object})

    kinds = "conv_id string, block long, formatted string, turns array<struct<start:int,`end`:int,text_start:int,text_end:int,role:string>>, rewrites array<int>"
    out = _ordered(df, conv, turn, role, text).select("conv_id", "role", "text").mapInPandas(run, kinds)
    return out.withColumn("conv_id", F.col("conv_id").cast(df.schema[conv].dataType))


def chat_digests(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_rewrites: read back from what default_template wrote."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_rewrites"]
        rows = (_digest(c, turns, set(trained), default_template) for c, turns in _conversations(batches))
        while done := list(islice(rows, 1000)):
            yield pd.DataFrame(done, columns=names).astype({"conv_id": object})

    out = _ordered(df, conv, turn, role, text).select("conv_id", "role", "text").mapInPandas(run, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_rewrites long")
    return out.withColumn("conv_id", F.col("conv_id").cast(df.schema[conv].dataType))

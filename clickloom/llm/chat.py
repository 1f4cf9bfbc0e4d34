"""Chat formatting by incremental rendering of a black-box template.

A template is any function from a list of (role, text) to a string. Prefixes of a conversation are
rendered one after another; what a prefix adds to the one before is its last turn's span. If a
longer prefix does not start with the shorter one's output, the template rewrites history.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

START, END = "<|im_start|>", "<|im_end|>"
Template = Callable[[list[tuple[str, str]]], str]
#: A private-use character: rendered in a turn's place, it shows where the turn's text goes.
PROBE = ""


def escape(text: str) -> str:
    """Add a backslash inside every "<|" (also where some already stand): no control string is left."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "<\\" in text else text


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def marked_turns(messages: list[tuple[str, str]]) -> str:
    """The production template."""
    return "".join(f"{START}{_role(r)}\n{escape(t)}{END}\n" for r, t in messages)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns that marked_turns wrote."""
    return [(_unrole(m[1]), unescape(m[2])) for m in re.finditer(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + "\n", formatted, re.S)]


def common_prefix(a: str, b: str) -> int:
    """Length of what two strings both begin with, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low + 1 < high:
        middle = (low + high) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle)
    return low


def probe_for(messages: list[tuple[str, str]], output: str) -> str:
    """A text that no role, text or output holds: rendered in a turn's place, it shows where the
    turn's text goes."""
    k = 0
    while any(f"\ue000{k}\ue001" in s for s in (output, *(x for m in messages for x in m))):
        k += 1
    return f"\ue000{k}\ue001"


def render_spans(messages: list[tuple[str, str]], template: Template) -> tuple[str, list[tuple[int, int] | None], list[tuple[int, int] | None], bool]:
    """(output, turn spans, text spans, rewrites): spans in the full output, None for turns whose
    output a later prefix changed; rewrites tells whether there are such turns."""
    out, turns, texts, rewrites = "", [], [], False
    probe = probe_for(messages, template(messages)) if messages else ""
    for i, (role, _) in enumerate(messages):
        new = template(messages[: i + 1])
        if new.startswith(out):
            common = len(out)
        else:
            rewrites, common = True, common_prefix(out, new)
            turns = [s if s and s[1] <= common else None for s in turns]
            texts = [s if s and s[1] <= common else None for s in texts]
        turns.append((common, len(new)))
        shown = template([*messages[:i], (role, probe)])
        head = shown.find(probe, common if shown.startswith(new[:common]) else common_prefix(shown, new[:common]))
        tail = len(shown) - head - len(probe)
        # Around the probe both outputs have to agree, or the template does not just insert the text.
        fits = 0 <= head <= len(new) - tail and new.startswith(shown[:head]) and new.endswith(shown[head + len(probe) :])
        texts.append((head, len(new) - tail) if fits else None)
        out = new
    return out, turns, texts, rewrites


def format_conversations(conversations: DataFrame, template: Template = marked_turns, loss_role: str = "assistant") -> DataFrame:
    """One row per conv_id: formatted, loss_spans (of the texts of loss_role), rewrites_history.

    Turns go by turn, then role and text, so that ties and repeated rows have one order; null texts
    and roles count as empty, a null turn goes first and rows without a conv_id form one
    conversation. Columns other than conv_id, turn, role and text are ignored. A conversation is one
    output string, so its turns meet in one task; conversations are spread by conv_id.
    """
    turns = conversations.select(
        "conv_id", F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("_turn")
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("_turn")).alias("_turns"))
    kind = dict(whole.dtypes)["conv_id"]

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            out, spans, odd = [], [], []
            for turns in batch.column("_turns"):
                messages = [(t["role"], t["text"]) for t in turns.as_py()]
                text, _, where, rewrites = render_spans(messages, template)
                out.append(text)
                spans.append([{"start": s[0], "end": s[1]} for (role, _), s in zip(messages, where, strict=True) if role == loss_role and s])
                odd.append(rewrites)
            return {
                "conv_id": batch.column("conv_id"),
                "formatted": pa.array(out, pa.string()),
                "loss_spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "rewrites_history": pa.array(odd, pa.bool_()),
            }

        return run

    return map_batches(whole, f"conv_id {kind}, formatted string, loss_spans array<struct<start: bigint, end: bigint>>, rewrites_history boolean", make)


def digest_formatted(formatted: DataFrame) -> DataFrame:
    """Read the production template's output back: numbers and digests of turns and of loss text."""
    kind = dict(formatted.dtypes)["conv_id"]

    def make():
        def run(batch: pa.RecordBatch) -> dict:
            rows = {"n_turns": [], "turns_sha256": [], "loss_chars": [], "loss_sha256": [], "formatted_chars": []}
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                rows["n_turns"].append(len(turns))
                rows["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                rows["loss_chars"].append(len(loss))
                rows["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
                rows["formatted_chars"].append(len(text))
            return {"conv_id": batch.column("conv_id"), "rewrites_history": batch.column("rewrites_history")} | rows

        return run

    return map_batches(formatted, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean", make)

"""The seam for model calls: a backend a partition, deterministic stubs, replay of saved calls, methods of several stages.

Rows that need no call are split off before the Python stage. A failed row is a row with an error, never a failed job,
except for errors of memory, which are raised.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import small_batches


class Backend:
    """What a model must offer. Subclass it, and give a function that makes one; it is called once a partition."""

    def generate(self, stage_id: str, messages: list[dict], max_new_tokens: int, seed: int) -> str:
        raise NotImplementedError

    def count_text_tokens(self, text: str) -> int:
        return len(text.split())


class Stub(Backend):
    """Deterministic outputs that have the shape each stage asks for."""

    def generate(self, stage_id: str, messages: list[dict], max_new_tokens: int, seed: int) -> str:
        mark = messages_hash(messages)[:8]
        if stage_id.startswith("queries"):
            return json.dumps({"queries": [{"query": f"query {i} {mark}", "probability": 100 - i} for i in range(5)]})
        if stage_id.startswith("suggestions"):
            return json.dumps({"suggestions": [{"excerpt": f"excerpt {mark}", "suggestion": f"suggestion {seed}", "necessity": n} for n in (80, 40)]})
        return f"{stage_id} {mark} {seed}: " + " ".join(messages[-1]["content"].split()[:max_new_tokens])


class Replay(Backend):
    """Saved outputs by stage and message hash; calls that aren't saved go to the backend behind, or raise LookupError."""

    def __init__(self, saved: dict[tuple[str, str], str], behind: Backend | None = None):
        self.saved, self.behind, self.replayed = saved, behind, 0

    def generate(self, stage_id: str, messages: list[dict], max_new_tokens: int, seed: int) -> str:
        found = self.saved.get((stage_id, messages_hash(messages)))
        if found is not None:
            self.replayed += 1
            return found
        if self.behind is None:
            raise LookupError(f"no saved call of {stage_id}")
        return self.behind.generate(stage_id, messages, max_new_tokens, seed)


def messages_hash(messages: list[dict]) -> str:
    return hashlib.sha256(json.dumps(messages, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@dataclass
class Stage:
    """One kind of call: how many of it, and the prompt of call i from the document and earlier outputs by stage."""

    stage_id: str
    prompt: Callable[[str, dict[str, list[str]], int], str]
    calls: int = 1
    max_new_tokens: int = 512
    parse: Callable[[str], str] = str.strip


@dataclass
class Method:
    method_id: str
    stages: list[Stage]
    system: str = ""
    calls: int = field(init=False)

    def __post_init__(self) -> None:
        self.calls = sum(s.calls for s in self.stages)

    def run(self, backend: Backend, document: str, seed: int) -> tuple[str, list[dict]]:
        """The last stage's output, and a record of every call."""
        outputs: dict[str, list[str]] = {}
        records = []
        for s in self.stages:
            outputs[s.stage_id] = []
            for i in range(s.calls):
                messages = [*([{"role": "system", "content": self.system}] if self.system else []), {"role": "user", "content": s.prompt(document, outputs, i)}]
                raw = backend.generate(s.stage_id, messages, s.max_new_tokens, seed)
                outputs[s.stage_id].append(s.parse(raw))
                tokens = backend.count_text_tokens(raw)
                records.append({"stage_id": s.stage_id, "call": i, "messages_sha256": messages_hash(messages), "output": raw, "output_tokens": tokens, "cap_hit": tokens >= s.max_new_tokens})
        if len(records) != self.calls:
            raise ValueError(f"{self.method_id} made {len(records)} calls, not {self.calls}")
        return outputs[self.stages[-1].stage_id][-1], records


RECORD = "array<struct<stage_id:string,call:int,messages_sha256:string,output:string,output_tokens:int,cap_hit:boolean>>"


def error_payload(e: BaseException) -> str:
    """Everything of an exception, with the ones that it came from."""
    chain = []
    while e is not None:
        chain.append({"type": type(e).__name__, "message": str(e), "args": [repr(a) for a in e.args]})
        e = e.__cause__ or e.__context__
    return json.dumps(chain, ensure_ascii=False)


def rewritten(documents: DataFrame, methods: dict[str, Method], make_backend: Callable[[], Backend], seed: int = 0, key: str = "sample_id", text: str = "source_text") -> DataFrame:
    """key, method_id, rewritten_text, stage_records, error of each document and method_id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make_backend()
        for b in batches:
            rows = []
            for k, m, t in zip(b[key], b["method_id"], b[text]):
                try:
                    out, records = methods[m].run(backend, t, seed)
                    rows.append((k, m, out, records, None))
                except MemoryError:
                    raise
                except Exception as e:
                    rows.append((k, m, None, None, error_payload(e)))
            yield pd.DataFrame(rows, columns=[key, "method_id", "rewritten_text", "stage_records", "error"])

    small_batches(documents.sparkSession)
    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, "method_id", text).mapInPandas(run, f"{key} {kind}, method_id string, rewritten_text string, stage_records {RECORD}, error string")


def generated(rows: DataFrame, keys: list[str], make_backend: Callable[[], Backend], stage_id: str, max_new_tokens: int, budget: int | None = None, seed: str = "answer_seed", output: str = "answer") -> DataFrame:
    """keys, output, input_tokens, output_tokens, cap_hit, error_type, error. rows has `messages`, an array of struct(role, content); more input tokens than the budget make an error row without a call."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = make_backend()
        for b in batches:
            rows = []
            for *k, s, messages in zip(*[b[c] for c in keys], b[seed], b["messages"]):
                messages = [{"role": m["role"], "content": m["content"]} for m in messages]
                n = sum(backend.count_text_tokens(m["content"]) for m in messages)
                if budget is not None and n > budget:
                    rows.append((*k, None, n, None, None, "input_budget_overflow", f"{n} > {budget}"))
                    continue
                try:
                    out = backend.generate(stage_id, messages, max_new_tokens, int(s))
                    used = backend.count_text_tokens(out)
                    rows.append((*k, out, n, used, used >= max_new_tokens, None, None))
                except MemoryError:
                    raise
                except Exception as e:
                    rows.append((*k, None, n, None, None, type(e).__name__, error_payload(e)))
            out = pd.DataFrame(rows, columns=[*keys, output, "input_tokens", "output_tokens", "cap_hit", "error_type", "error"])
            yield out.astype({"output_tokens": "Int32", "cap_hit": "boolean"})

    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)
    small_batches(rows.sparkSession)
    names = [*keys] if seed in keys else [*keys, seed]
    return rows.select(*names, "messages").mapInPandas(run, f"{types}, {output} string, input_tokens int, output_tokens int, cap_hit boolean, error_type string, error string")


def judged(answers: DataFrame, trials: DataFrame, make_backend: Callable[[], Backend], keys: list[str], max_new_tokens: int = 16) -> DataFrame:
    """Trials of cited answers through the backend; the others get score 0 without a call. answers has target_source_cited and messages."""
    from .judge import absence_rule, reparsed

    rows = trials.join(answers, keys[:-2])
    called = generated(rows.where("target_source_cited"), keys, make_backend, "judge", max_new_tokens, seed="judge_seed", output="raw_output").withColumn("target_source_cited", F.lit(True))
    zeros = rows.where("not target_source_cited").select(*keys, F.lit(None).cast("string").alias("raw_output"), *[F.lit(None).cast(t).alias(c) for c, t in (("input_tokens", "int"), ("output_tokens", "int"), ("cap_hit", "boolean"), ("error_type", "string"), ("error", "string"))], F.lit(False).alias("target_source_cited"))
    scored = reparsed(called.unionByName(zeros)).drop("stored_score")
    return absence_rule(scored)


def replayable(records: DataFrame) -> dict[tuple[str, str], str]:
    """The saved calls of one document's records, for a Replay backend."""
    return {(r.stage_id, r.messages_sha256): r.output for r in records.select("stage_id", "messages_sha256", "output").collect()}

"""The annotation client and the passes that call it.

A client has ``generate(system, user, seed) -> Answer`` and is made once per
partition from a factory that executors can unpickle. Calls run in
``mapInPandas``, after everything that prunes them; their answers are written
before anything reads them, so no call is repeated through lineage.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
from collections import OrderedDict
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import prompts as P
from lexiloom.functions.json_rules import validate_generation, validate_judgement, validate_verification
from lexiloom.functions.text import retry_seed
from lexiloom.operators import resolve
from lexiloom.plans.materialise import materialise
from lexiloom.sources.tables import in_run_order


class ModelError(RuntimeError):
    """A client gave up."""


class Answer(NamedTuple):
    text: str
    finish_reason: str = ""
    prompt_tokens: int | None = None
    completion_tokens: int | None = None


class Client(Protocol):
    def generate(self, system: str, user: str, seed: int | None = None) -> Answer: ...


def cache_key(system: str, user: str, model: str, temperature: float, seed: int | None) -> str:
    return hashlib.sha256("\x1f".join([system, user, model, repr(temperature), repr(seed)]).encode()).hexdigest()


class HashClient:
    """A stand-in whose answers follow from the prompt alone: ``answer(user, digest)`` gives the text."""

    def __init__(self, answer: Callable[[str, int], str]):
        self.answer = answer

    def generate(self, system: str, user: str, seed: int | None = None) -> Answer:
        digest = int.from_bytes(hashlib.sha256(f"{system}\x1f{user}\x1f{seed}".encode()).digest()[:8], "big")
        return Answer(self.answer(user, digest), "stop")


class ReplayClient:
    """Answers from a mapping of user prompts; others fail."""

    def __init__(self, answers: dict[str, str]):
        self.answers = answers

    def generate(self, system: str, user: str, seed: int | None = None) -> Answer:
        if user not in self.answers:
            raise ModelError("no answer is known")
        return Answer(self.answers[user], "stop")


class HttpClient:
    """A chat-completion endpoint, with retries after growing pauses and a cache of the ``cached`` latest answers per client."""

    def __init__(self, url: str, model: str, temperature: float = 0.0, retries: int = 3, pause: float = 1.0, timeout: float = 120.0, max_tokens: int | None = None, response_format: dict | None = None, cached: int = 10_000):
        self.url, self.model, self.temperature, self.retries, self.pause, self.timeout = url, model, temperature, retries, pause, timeout
        self.fixed = {k: v for k, v in (("max_tokens", max_tokens), ("response_format", response_format)) if v is not None}
        self.cached, self.cache = cached, OrderedDict()

    def _post(self, body: dict) -> dict:
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)

    def generate(self, system: str, user: str, seed: int | None = None) -> Answer:
        key = cache_key(system, user, self.model, self.temperature, seed)
        if key in self.cache:
            return self.cache[key]
        messages = [{"role": "system", "content": system}] * bool(system) + [{"role": "user", "content": user}]
        body = {"model": self.model, "temperature": self.temperature, "messages": messages} | self.fixed | ({} if seed is None else {"seed": seed})
        for attempt in range(1, self.retries + 1):
            try:
                got = self._post(body)
                choice, usage = got["choices"][0], got.get("usage") or {}
                out = Answer(choice["message"]["content"], choice.get("finish_reason") or "", usage.get("prompt_tokens"), usage.get("completion_tokens"))
                break
            except Exception as e:
                if attempt == self.retries:
                    raise ModelError(f"{type(e).__name__}: {e}") from e
                time.sleep(self.pause * attempt)
        self.cache[key] = out
        while len(self.cache) > self.cached:
            self.cache.popitem(last=False)
        return out


ANSWER = {"raw_json": "string", "finish_reason": "string", "prompt_tokens": "int", "completion_tokens": "int", "call_error": "string"}


def call(jobs: DataFrame, factory: Callable[[], Client], tag: str = "calls", workers: int = 8) -> DataFrame:
    """``jobs`` (with system, user, sampling_seed) and the columns of ANSWER; written once.

    Equal prompts with equal seeds are asked once and joined back by a 128-bit
    hash of them. A call that fails has an empty text and its error.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("system", "user", "sampling_seed")]
    keyed = jobs.withColumn("__ask", F.md5(F.concat_ws("\x1f", *parts)))
    asked = keyed.select("__ask", "system", "user", "sampling_seed").dropDuplicates(["__ask"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()

        def one(row) -> tuple:
            try:
                return *Answer(*client.generate(row.system, row.user, None if row.seed is None else int(row.seed))), ""
            except Exception as e:
                return "", "", None, None, f"LLM call error: {type(e).__name__}: {e}"

        with ThreadPoolExecutor(workers) as pool:
            for pdf in batches:
                got = list(pool.map(one, pdf.itertuples()))
                columns = {c: pd.Series([g[i] for g in got], dtype="Int32" if kind == "int" else object) for i, (c, kind) in enumerate(ANSWER.items())}
                yield pd.DataFrame({"ask": pdf["ask"].reset_index(drop=True)} | columns)

    # Seeds have 63 bits, which a column with nulls would lose as floats.
    sent = asked.select(F.col("__ask").alias("ask"), "system", "user", F.col("sampling_seed").cast("string").alias("seed"))
    answers = materialise(sent.mapInPandas(run, ", ".join(["ask string", *[f"{c} {kind}" for c, kind in ANSWER.items()]])), tag)
    return keyed.join(answers.withColumnRenamed("ask", "__ask"), "__ask", "left").drop("__ask")


def _judged(called: DataFrame) -> DataFrame:
    out = called.withColumn("__v", validate_judgement(F.col("raw_json"), F.col("word"), F.col("feature_id")))
    return out.withColumns({
        "parse_error": F.when(F.col("call_error") != "", F.col("call_error")).otherwise(F.col("__v.parse_error")),
        "value": F.col("__v.record.feature_value"),
        "confidence": F.coalesce("__v.record.confidence", F.lit(0.0)),
        "ambiguous": F.coalesce("__v.record.ambiguous", F.lit(False)),
        "reason": F.coalesce("__v.record.reason", F.lit("")),
    }).drop("__v", "call_error", "prompt_tokens", "completion_tokens")


def judge_panel(pairs: DataFrame, factory: Callable[[], Client], judges: tuple[str, ...] = ("A", "B", "C"), tag: str = "votes") -> DataFrame:
    """A vote of each judge on each pair (word, feature_id, feature_text), with one more try for what did not parse.

    The second try has a seed of its own, so that a cache cannot give the same
    text again. A vote that fails twice has no value, confidence 0.0, and its
    raw text and error. No pair is lost.
    """
    jobs = pairs.withColumn("judge_id", F.explode(F.array(*map(F.lit, judges)))).withColumns({"system": P.judge_system("judge_id"), "user": P.judge_user("word", "feature_id", "feature_text"), "sampling_seed": F.lit(0).cast("long")})
    first = materialise(_judged(call(jobs, factory, tag)), tag)
    again = first.where("parse_error <> ''").select(*jobs.columns).withColumn("sampling_seed", F.lit(1).cast("long"))
    second = _judged(call(again, factory, tag))
    return first.where("parse_error = ''").unionByName(second).drop("system", "user")


def adjudicators(pairs: DataFrame, votes: DataFrame, factory: Callable[[], Client], n: int = 3, tag: str = "adjudicators") -> DataFrame:
    """A vote of each of ``n`` adjudicators on each of ``pairs`` (word, feature_id, feature_text), who are shown the judges' ``votes``.

    All are asked the same without a seed, once each; an answer that does not
    parse gives no value.
    """
    shown = resolve.gather(votes, ["word", "feature_id"])
    jobs = pairs.join(shown, ["word", "feature_id"]).withColumns({"system": F.lit(P.load("adjudicator", "v2")), "user": P.adjudicator_user("word", "feature_id", "feature_text", "votes"), "sampling_seed": F.lit(None).cast("long")}).drop("votes")
    jobs = jobs.withColumn("judge_id", F.explode(F.array(*[F.lit(str(i)) for i in range(1, n + 1)])))
    return _judged(call(jobs, factory, tag)).drop("system", "user", "sampling_seed")


def verifier(candidates: DataFrame, factory: Callable[[], Client], threshold: float = 1.0, tag: str = "verify") -> DataFrame:
    """The verifier's value for each candidate (word, feature_id, feature_text, final_value); null if two answers do not parse."""
    def asked(jobs: DataFrame) -> DataFrame:
        checked = call(jobs, factory, tag).withColumn("__v", validate_verification(F.col("raw_json"), F.col("word"), F.col("feature_id"), threshold))
        record = {"verified_value": "verified_feature_value", "retain_positive": "retain_positive", "verification_confidence": "confidence", "verification_reason": "reason"}
        return checked.select(*jobs.columns, *[F.col(f"__v.record.{field}").alias(name) for name, field in record.items()], F.when(F.col("call_error") != "", F.col("call_error")).otherwise(F.col("__v.parse_error")).alias("parse_error"))

    jobs = candidates.withColumns({"system": P.verifier_system(), "user": P.verifier_user("word", "feature_id", "feature_text", "final_value"), "sampling_seed": F.lit(0).cast("long")})
    first = materialise(asked(jobs), tag)
    again = first.where("parse_error <> ''").select(*jobs.columns).withColumn("sampling_seed", F.lit(1).cast("long"))
    return first.where("parse_error = ''").unionByName(asked(again)).drop("system", "user", "sampling_seed")


def generate_features(jobs: DataFrame, factory: Callable[[], Client], run_id: int = 0, version: str = "v3", word: str = "word", tag: str = "responses") -> DataFrame:
    """Log rows of generation jobs (plans.jobs.generation_jobs): features, parse_error, raw text, token counts and ingest_seq.

    An answer that does not parse is asked for once more, with the retry seed;
    sampling_seed is the seed of the answer that is kept. A request that fails is
    not asked again, and has the job's own seed.
    """
    def asked(rows: DataFrame) -> DataFrame:
        checked = call(rows, factory, tag).withColumn("__v", validate_generation(F.col("raw_json"), F.col(word)))
        return checked.withColumns({
            "features": F.coalesce("__v.record.features", F.expr("cast(array() as array<string>)")),
            "failed": F.col("call_error") != "",
            "parse_error": F.when(F.col("call_error") != "", F.concat(F.lit("Request error: "), F.col("call_error"))).otherwise(F.col("__v.parse_error")),
        }).drop("__v", "call_error")

    sent = jobs.withColumns({"system": P.generation_system("prompt_variant", version), "user": P.generation_user(word), "own_seed": F.col("sampling_seed")})
    first = materialise(asked(sent), tag)
    again = first.where("parse_error <> '' and not failed").select(*sent.columns).withColumn("sampling_seed", retry_seed("sampling_seed", 1))
    second = asked(again).withColumn("sampling_seed", F.when(F.col("failed"), F.col("own_seed")).otherwise(F.col("sampling_seed")))
    rows = first.where("parse_error = '' or failed").unionByName(second).withColumn("n_features", F.size("features"))
    return in_run_order(rows.drop("failed", "system", "user", "own_seed"), run_id)

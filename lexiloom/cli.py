"""Passes from the command line: ``python -m lexiloom.cli generate|revalidate|label|validate|expand ...``.

Tables are written as Parquet below ``--out``, reports as JSON. A client is a
chat-completion endpoint (``--url`` and ``--model``), or ``--client
package.module:factory``.
"""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable, Sequence
from datetime import datetime, timezone
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators import matrix, models, passes
from lexiloom.plans import jobs
from lexiloom.sources import tables

LOG = logging.getLogger("lexiloom")


def _arguments(argv: Sequence[str] | None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="lexiloom", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, asks: bool, *own: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.add_argument("--out", required=True, help="folder of the pass")
        for flag in own:
            p.add_argument(f"--{flag.rstrip('?')}", required=not flag.endswith("?"))
        if asks:
            p.add_argument("--model", default="model")
            p.add_argument("--url")
            p.add_argument("--client")
            p.add_argument("--temperature", type=float, default=0.8 if name == "generate" else 0.0)
            p.add_argument("--max-tokens", type=int, default=500)
        return p

    generate = command("generate", True, "items", "item-column?")
    generate.add_argument("--variants", default="A,B,C")
    generate.add_argument("--replicates", type=int, default=20)
    generate.add_argument("--base-seed", type=int, default=1)
    generate.add_argument("--version", default="v3")
    generate.add_argument("--max-words", type=int)
    generate.add_argument("--no-resume", dest="resume", action="store_false")
    generate.add_argument("--preflight-only", action="store_true")
    command("revalidate", False)
    label = command("label", True, "matrix", "items", "item-column?")
    label.add_argument("--no-verify", dest="verify", action="store_false")
    validate = command("validate", True, "matrix", "categories?")
    validate.add_argument("--mode", choices=("cells", "words"), default="cells")
    validate.add_argument("--fraction", type=float, default=0.2)
    validate.add_argument("--no-verify", dest="verify", action="store_false")
    command("expand", False, "matrix", "items", "item-column?", "resolutions", "plurals?", "occurrences?")
    return top.parse_args(argv)


def _factory(args: argparse.Namespace) -> Callable[[], models.Client]:
    if args.client:
        module, _, name = args.client.partition(":")
        return getattr(import_module(module), name)
    if not args.url:
        raise ValueError("a client needs --url or --client")
    url, model, temperature, most = args.url, args.model, args.temperature, args.max_tokens
    return lambda: models.HttpClient(url, model, temperature, max_tokens=most)


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _items(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return tables.read_items(spark, args.items, args.item_column or "word")


def _report(spark: SparkSession, row: DataFrame, path: str) -> None:
    tables.write_manifest(spark, json.loads(row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0]), path)


def generate(spark: SparkSession, args: argparse.Namespace) -> None:
    out = args.out.rstrip("/")
    items, variants = _items(spark, args), tuple(args.variants.split(","))
    if args.max_words:
        items = jobs.even_subset(items, args.max_words, "input_seq")
    config = {"model": args.model, "base_seed": args.base_seed, "variants": list(variants), "replicates": args.replicates}
    said = {"version": args.version, "temperature": args.temperature, "max_tokens": args.max_tokens}
    stored = tables.read_manifest(spark, f"{out}/manifest") if _there(spark, f"{out}/manifest") else None
    if stored and not args.resume:
        raise FileExistsError(f"{out} holds a pass; resume it, or name another folder")
    jobs.check_drift(config | said, stored)
    if args.preflight_only:
        jobs.preflight(items.select("word").distinct(), variants, args.replicates, args.base_seed, args.model, args.temperature, version=args.version).show()
        return
    log = spark.read.parquet(f"{out}/log") if _there(spark, f"{out}/log") else None
    run = 1 + (log.agg(F.max("run_id")).first()[0] if log is not None else 0)
    hashes = {r["path"]: r["sha256"] for r in tables.file_hashes(spark, args.items).collect()}
    plan = (stored or {}) | config | said | {"inputs": hashes, "started_at": datetime.now(timezone.utc).isoformat()}
    tables.write_manifest(spark, plan, f"{out}/manifest")
    done = passes.run_generation(items, _factory(args), variants, args.replicates, args.base_seed, args.model, args.temperature, args.version, log, run_id=run)
    done.log.where(F.col("run_id") == run).write.mode("append").parquet(f"{out}/log")
    tables.write_table(done.long, f"{out}/features_long")
    tables.write_table(done.frequencies, f"{out}/frequencies")
    planned = items.select("word").distinct().count() * len(variants) * args.replicates
    tables.write_manifest(spark, plan | {"total_planned_responses": planned, "pending_after_run": done.pending, "finished_at": datetime.now(timezone.utc).isoformat()}, f"{out}/manifest")


def revalidate(spark: SparkSession, args: argparse.Namespace) -> None:
    out = args.out.rstrip("/")
    for name in ("log", "manifest"):
        if not _there(spark, f"{out}/{name}"):
            raise FileNotFoundError(f"{out}/{name}")
    log = spark.read.parquet(f"{out}/log")
    done = passes.run_revalidation(log, tables.read_manifest(spark, f"{out}/manifest"), datetime.now(timezone.utc).isoformat(), _there(spark, f"{out}/manifest_before"))
    done.log.join(log.select("response_id", "ingest_seq"), ["response_id", "ingest_seq"], "left_anti").write.mode("append").parquet(f"{out}/log")
    tables.write_table(done.long, f"{out}/features_long")
    tables.write_table(done.frequencies, f"{out}/frequencies")
    if done.backup is not None:
        tables.write_manifest(spark, done.backup, f"{out}/manifest_before")
    tables.write_manifest(spark, done.manifest, f"{out}/manifest")


def _write(found: passes.Labelling, out: str) -> None:
    for name, table in zip(found._fields, found):
        tables.write_table(table, f"{out}/{name}")


def label(spark: SparkSession, args: argparse.Namespace) -> None:
    out = args.out.rstrip("/")
    features = tables.feature_schema(spark, args.matrix)
    existing = tables.read_matrix(spark, args.matrix).select("word_normalized").distinct()
    words = matrix.new_items(_items(spark, args), existing).select(F.col("word_normalized").alias("word"))
    votes = spark.read.parquet(f"{out}/votes") if _there(spark, f"{out}/votes") else None
    _write(passes.run_labelling(jobs.labelling_jobs(words, features), _factory(args), votes, args.verify), out)


def validate(spark: SparkSession, args: argparse.Namespace) -> None:
    out = args.out.rstrip("/")
    cells = tables.read_matrix(spark, args.matrix)
    if args.mode == "cells":
        found = passes.holdout_cells(cells, _factory(args), args.fraction, verify=args.verify)
    else:
        found = passes.holdout_words(cells, tables.read_categories(spark, args.categories) if args.categories else None, _factory(args), args.fraction, verify=args.verify)
    _write(found.labelling, out)
    tables.write_table(found.cells, f"{out}/cells")
    _report(spark, found.report, f"{out}/report")


def expand(spark: SparkSession, args: argparse.Namespace) -> None:
    out = args.out.rstrip("/")
    original = tables.read_csv(spark, args.matrix)
    plurals = tables.read_plurals(spark, args.plurals) if args.plurals else None
    resolved = spark.read.parquet(args.resolutions).withColumnRenamed("word", "word_normalized")
    expanded = passes.run_expansion(original, original.columns[0], _items(spark, args), resolved, plurals=plurals)
    tables.write_table(expanded, f"{out}/expanded")
    if args.occurrences:
        expanded = spark.read.parquet(f"{out}/expanded")
        seen = tables.read_csv(spark, args.occurrences)
        tables.write_table(matrix.annotate_occurrences(seen, expanded, seen.columns[0]), f"{out}/occurrences")
        _report(spark, matrix.coverage_summary(matrix.covered(seen, expanded, seen.columns[0])), f"{out}/coverage")


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _arguments(argv)
    spark = spark or SparkSession.builder.appName("lexiloom").getOrCreate()
    {"generate": generate, "revalidate": revalidate, "label": label, "validate": validate, "expand": expand}[args.command](spark, args)
    LOG.info("%s: done, see %s", args.command, args.out)


if __name__ == "__main__":
    logging.basicConfig(level=logging.INFO)
    main()

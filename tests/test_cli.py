"""Passes from the command line, with stand-in clients."""

import json
import sys

import pytest
from pyspark import cloudpickle

from lexiloom import cli
from lexiloom.operators import models as M
from lexiloom.sources import tables

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors do not import tests

MATRIX = 'Name,is an animal,is a tool,has legs\nDog,4,0,3\ncat,4,0,3\nhammer,0,4,0\nchair,0,0,4\nsaw,0,3,0\nhorse,4,0,4\n'
GOLD = {"dog": (4, 0, 3), "cat": (4, 0, 3), "hammer": (0, 4, 0), "chair": (0, 0, 4), "saw": (0, 3, 0), "horse": (4, 0, 4), "wolf": (4, 0, 3)}


class Knowing:
    """Judges and a verifier who know the matrix; a generator whose first answers for one word are cut."""

    def generate(self, system, user, seed=None):
        asked = json.loads(user)
        if "target_word" in asked:
            body = json.dumps({"target_word": asked["target_word"], "features": ["is a thing"]})
            return M.Answer(body[:-1] if asked["target_word"] == "cat" else body, "stop")
        body = {"word": asked["word"], "feature_id": asked["feature_id"], "confidence": 0.9, "reason": ""}
        value = GOLD[asked["word"]][asked["feature_id"]]
        return M.Answer(json.dumps(body | ({"verified_feature_value": value, "retain_positive": True} if "rating" in asked else {"feature_value": value, "ambiguous": False})))


def knowing():
    return Knowing()


@pytest.fixture
def files(tmp_path):
    (tmp_path / "matrix.csv").write_text(MATRIX)
    (tmp_path / "items.csv").write_text("word\nDog\nCat\nWolf\n")
    (tmp_path / "categories.csv").write_text("Name,Category\nDog,animal\ncat,animal\nhorse,animal\nhammer,tool\nsaw,tool\n")
    return tmp_path


CLIENT = ["--client", "tests.test_cli:knowing"]


def run(spark, *argv):
    cli.main([str(a) for a in argv], spark)


def test_generate_and_revalidate(spark, files):
    out = files / "generation"
    args = ["generate", "--out", out, "--items", files / "items.csv", "--replicates", 2, "--variants", "A,B", *CLIENT]
    run(spark, *args, "--preflight-only")
    assert not out.exists()
    run(spark, *args)
    log = spark.read.parquet(str(out / "log"))
    manifest = tables.read_manifest(spark, str(out / "manifest"))
    assert log.count() == 12 and manifest["total_planned_responses"] == 12 and manifest["pending_after_run"] == 4 and len(manifest["inputs"]) == 1
    run(spark, *args)  # only what failed is asked again
    assert spark.read.parquet(str(out / "log")).count() == 16
    assert spark.read.parquet(str(out / "frequencies")).count() == 4
    with pytest.raises(FileExistsError):
        run(spark, *args, "--no-resume")
    with pytest.raises(ValueError):
        run(spark, *args[:-2], *CLIENT, "--temperature", 0.5)
    run(spark, "revalidate", "--out", out)
    again = tables.read_manifest(spark, str(out / "manifest"))
    assert again["parse_errors_total"] == 4 and again["revalidation_history"][0]["repaired_responses"] == 0
    with pytest.raises(FileNotFoundError):
        run(spark, "revalidate", "--out", files / "nothing")
    with pytest.raises(ValueError):
        run(spark, *args[:-2])


def test_label_and_expand(spark, files):
    out = files / "labels"
    run(spark, "label", "--out", out, "--matrix", files / "matrix.csv", "--items", files / "items.csv", *CLIENT)
    rows = {r["feature_id"]: (r["word"], r["final_value"], r["verification_status"]) for r in spark.read.parquet(str(out / "resolutions")).collect()}
    assert rows == {0: ("wolf", 4.0, "retained"), 1: ("wolf", 0.0, "not_candidate"), 2: ("wolf", 3.0, "retained")}
    (files / "seen.csv").write_text("key\nwolf\ndog\nunicorn\n")
    run(spark, "expand", "--out", files / "expanded", "--matrix", files / "matrix.csv", "--items", files / "items.csv", "--resolutions", out / "resolutions", "--occurrences", files / "seen.csv")
    found = {r["word_normalized"]: r for r in spark.read.parquet(str(files / "expanded" / "expanded")).collect()}
    assert len(found) == 7 and (found["wolf"]["is an animal"], found["wolf"]["has legs"], found["wolf"]["source"]) == (4.0, 3.0, "expansion")
    assert {r["key"]: r["source"] for r in spark.read.parquet(str(files / "expanded" / "occurrences")).collect()} == {"wolf": "expansion", "dog": "original", "unicorn": "missing"}
    assert tables.read_manifest(spark, str(files / "expanded" / "coverage"))["n_covered"] == 2


def test_validate(spark, files):
    run(spark, "validate", "--out", files / "cells", "--matrix", files / "matrix.csv", "--fraction", 0.5, *CLIENT)
    report = tables.read_manifest(spark, str(files / "cells" / "report"))
    assert report["accuracy"] == 1.0 and report["roc_auc"] == 1.0 and report["average_precision"] == 1.0 and report["tp"] + report["tn"] == 8
    run(spark, "validate", "--out", files / "words", "--matrix", files / "matrix.csv", "--mode", "words", "--categories", files / "categories.csv", "--fraction", 0.7, *CLIENT)
    report = tables.read_manifest(spark, str(files / "words" / "report"))
    assert report["n_items"] == 4 and report["mean_cosine"] == pytest.approx(1) and report["mean_nn_jaccard"] == 1.0

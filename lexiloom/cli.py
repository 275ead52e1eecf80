"""Command line: train, evaluate, apply and sweep. `python -m lexiloom.cli -all data.tsv -split 0.15 ...`"""

from __future__ import annotations

import argparse
import os
import re
import sys

from pyspark.sql import SparkSession

from lexiloom.operators import dataset, evaluate
from lexiloom.operators.model import Model, Options, fit
from lexiloom.sources import labelled

#: Accepted for compatibility; nothing reads them.
IGNORED = ("parts", "merger", "abname", "tokens", "gamma")


def boolean(text: str) -> bool:
    return text.lower() in ("true", "yes", "1")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexiloom", prefix_chars="-")
    for name in ("all", "train", "test", "model", "score", "log"):
        p.add_argument(f"-{name}", default="")
    p.add_argument("-split", type=float, default=0.1)
    p.add_argument("-stratify", type=boolean, nargs="?", const=True, default=True)
    p.add_argument("-dropSmallerThan", type=int, default=0)
    p.add_argument("-parScore", type=boolean, nargs="?", const=True, default=False)
    p.add_argument("-train-method", dest="method", default="mira", choices=["mira", "svm", "svmopen", "perceptron"])
    p.add_argument("-average", type=boolean, nargs="?", const=True, default=True)
    p.add_argument("-iterations", type=int, default=20)
    p.add_argument("-k-best", dest="k_best", type=int, default=4)
    p.add_argument("-slack", type=float, default=0.01)
    p.add_argument("-c", type=float, default=1.0)
    p.add_argument("-bkg-min-count", dest="min_count", type=int, default=2)
    p.add_argument("-bkg-prune", dest="prune", type=float, default=0.0)
    p.add_argument("-norm-cutoff", dest="cutoff", type=float, default=1e10)
    p.add_argument("-word-ngram-order", dest="word_order", type=int, default=1)
    p.add_argument("-char-ngram-order", dest="char_order", type=int, default=3)
    for name in IGNORED:
        p.add_argument(f"-{name}", nargs="?", help=argparse.SUPPRESS)
    return p


def config_file(text: str) -> dict[str, dict[str, str]]:
    """Sections of `key: value` or `key = value`; # comments (\\# is a #); {...} spans lines."""
    out: dict[str, dict[str, str]] = {"": {}}
    section = ""
    text = re.sub(r"(?<!\\)#[^\n]*", "", text).replace("\\#", "#")
    text = re.sub(r"\{([^}]*)\}", lambda m: m[1].replace("\n", "\x00"), text)
    for line in text.split("\n"):
        if m := re.fullmatch(r"\s*\[(.+?)\]\s*", line):
            section = m[1]
            out.setdefault(section, {})
        elif m := re.fullmatch(r"\s*([\w.-]+)\s*[:=]\s*(.*?)\s*", line):
            out[section][m[1]] = m[2].replace("\x00", "\n").strip()
    return out


def options(args: argparse.Namespace) -> Options:
    return Options(**{k: getattr(args, k) for k in ("char_order", "word_order", "min_count", "prune", "cutoff", "method", "iterations", "k_best", "slack", "average", "c")})


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> float:
    """The accuracy, 0 where there is nothing to test, -1 where the data is missing."""
    argv = list(sys.argv[1:] if argv is None else argv)
    if "-C" in argv:
        at = argv.index("-C")
        with open(argv[at + 1]) as file:
            given = config_file(file.read())
        argv[at : at + 2] = [x for s in given.values() for k, v in s.items() for x in (f"-{k}", v)]
    args = parser().parse_args(argv)
    source = args.train or args.all
    if not (source and os.path.exists(source)) and not (args.model and args.test):
        print(f"no such data: {source}", file=sys.stderr)
        return -1.0
    spark = spark or SparkSession.builder.getOrCreate()
    test = labelled.read_labelled(spark, args.test) if args.test else None
    if args.model and os.path.exists(args.model) and test is not None and not source:
        model = Model.load(spark, args.model)
    else:
        docs = labelled.read_labelled(spark, source)
        if args.dropSmallerThan:
            docs = dataset.drop_small(docs, args.dropSmallerThan)
        if args.stratify:
            docs = dataset.stratify(docs)
        if test is None and not args.train:
            parts = dataset.split(docs, args.split).persist()
            docs, test = parts.where("NOT is_test").drop("is_test"), parts.where("is_test").drop("is_test")
        model = fit(docs, options(args))
        if args.model:
            model.save(args.model)
            model = Model.load(spark, args.model)
    if test is None or not test.head(1):
        return 0.0
    outputs = model.outputs(test).persist()
    evaluate.confusion_table(outputs, model.labels).orderBy("truth").show(1000, False)
    if args.score:
        shown = evaluate.as_array(model.scores(test)).join(test, "doc_id")
        labelled.write_scores(shown, args.score)
    n, correct, accuracy = evaluate.accuracy(outputs).first()
    print(f"accuracy on {n}: {accuracy}")
    return float(accuracy)


if __name__ == "__main__":
    sys.exit(0 if main() >= 0 else 1)

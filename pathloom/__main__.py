"""Command line: embeddings of path records, and the comparison of two sets of them.

    python -m pathloom -E paths.jsonl [-P] [-O OUT] [--stdout]
    python -m pathloom -C A B [-F F1 F2] [-D] [-O OUT] [--plot]

Path records are JSON lines or Parquet with file, func_addr and tokens; lifting
machine code to them is not part of this package.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import model, similarity
from .operators.vocabulary import build_vocab, encode, token_freq
from .session import get_session, ship
from .sources import formats


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pathloom", description=__doc__.split("\n")[0])
    p.add_argument("-O", "--output", default=".", help="folder for results")
    p.add_argument("-E", "--encode", nargs="*", default=[], metavar="PATHS", help="path records to make embeddings of")
    p.add_argument("-P", "--use-predictor", action="store_true", help="one predicted vector per path instead of all places")
    p.add_argument("--stdout", action="store_true", help="show function addresses and embeddings as text")
    p.add_argument("-C", "--compare", nargs=2, metavar=("A", "B"), help="two folders of embeddings to compare")
    p.add_argument("-F", "--functions", nargs=2, metavar=("F1", "F2"), help="two functions only, with -C")
    p.add_argument("-D", "--dot-product", action="store_true", help="the inner product instead of the distance")
    p.add_argument("--plot", action="store_true", help="write the matrix behind a heat map as CSV")
    p.add_argument("--vocab", help="vocabulary as a JSON object; else that of the records")
    p.add_argument("--checkpoint", help="weights as npz; else from a seed")
    return p


def embeddings(spark: SparkSession, source: str, vocab: str | None, checkpoint: str | None, predictor: bool) -> DataFrame:
    """``func``, ``path_id`` (in order of lines), ``emb`` of a file or folder of path records."""
    paths = spark.read.parquet(source) if source.endswith(".parquet") else formats.read_paths(spark, source).filter("_corrupt_record IS NULL")
    paths = paths.select(F.coalesce("func_addr", F.lit("?")).alias("func"), F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"), F.monotonically_increasing_id().alias("path_id"))
    known = formats.read_vocab(spark, vocab) if vocab else build_vocab(token_freq(paths))
    size = known.agg(F.max("id")).first()[0] + 1
    weights = formats.load_checkpoint(checkpoint)[1] if checkpoint else model.init_weights(size)
    apply = model.predict_paths if predictor else model.encode_paths
    return apply(encode(paths, known), ["func", "path_id"], "ids", weights)


def compared(spark: SparkSession, a: str, b: str, functions: list[str] | None = None) -> DataFrame:
    """``f1`` of a, ``f2`` of b, ``distance``, ``inner_product`` of their functions, or of two of them."""
    sides = []
    for name, at, f in (("a", a, functions and functions[0]), ("b", b, functions and functions[1])):
        side = formats.read_embeddings(spark, at, f)
        sides.append(side.select(F.concat(F.lit(f"{name}/"), "func").alias("func"), F.concat_ws("/", F.lit(name), "func", F.col("path_id").cast("string")).alias("key"), "emb"))
    both = sides[0].unionByName(sides[1])
    linked = similarity.linkage(both, "key", "func", "emb", F.col("func").startswith("a/"), F.col("func").startswith("b/"))
    return linked.select(F.substring("f1", F.lit(3), F.length("f1")).alias("f1"), F.substring("f2", F.lit(3), F.length("f2")).alias("f2"), "distance", "inner_product")


def main(given: list[str] | None = None) -> int:
    """0 if something was done; missing files and functions are told of and skipped."""
    args, done = arguments().parse_args(given), 1
    spark = SparkSession.getActiveSession() or get_session()
    ship(spark)
    os.makedirs(args.output, exist_ok=True)
    for source in args.encode:
        if not os.path.exists(source):
            print(f"{source} does not exist")
            continue
        found = embeddings(spark, source, args.vocab, args.checkpoint, args.use_predictor)
        at = os.path.join(args.output, os.path.basename(source.rstrip("/")) + "-embeddings" + ("-predictor" if args.use_predictor else ""))
        formats.write_embeddings(found, at)
        if args.stdout:
            for r in formats.read_embeddings(spark, at).orderBy("func", "path_id").toLocalIterator():
                print(f"{r['func']}\n{formats.vector_text(r['emb'])}\n")
        done = 0
    if args.compare:
        missing = [x for x in args.compare if not os.path.exists(x)]
        for x in missing:
            print(f"{x} does not exist")
        if not missing:
            shown = "inner_product" if args.dot_product else "distance"
            linked = compared(spark, *args.compare, args.functions)
            rows = linked.select("f1", "f2", shown).orderBy("f1", "f2")
            if args.functions and rows.isEmpty():
                print("no such functions")
            for r in rows.toLocalIterator():
                print(f"{r['f1']}\t{r['f2']}\t{r[shown]}")
            if args.plot:
                similarity.heatmap(linked, shown).coalesce(1).write.mode("overwrite").option("header", True).csv(os.path.join(args.output, "heatmap"))
            done = 0
    return done


if __name__ == "__main__":
    raise SystemExit(main())

"""python -m cantorium.cli: list queries, run one over a folder of tables, or rescore poems with a lexicon."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from cantorium.operators import prosody
from cantorium.plans import registry
from cantorium.session import local_session
from cantorium.sources import files


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cantorium")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the queries")
    run = sub.add_parser("run", help="run a query and write CSV")
    run.add_argument("query", choices=sorted(registry.QUERIES))
    run.add_argument("--input-dir", required=True)
    run.add_argument("--output-dir", required=True)
    score = sub.add_parser("rescore", help="S23: score poems (parquet: id, cipai, content) again and write them with rhythm_score")
    for name in ("poems", "patterns", "rhymes", "merged", "output-dir"):
        score.add_argument(f"--{name}", required=True)
    score.add_argument("--rhyme-mode", choices=("compat", "strict"), default="compat")
    top.add_argument("--cpus", default="*")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return
    spark = local_session(args.cpus)
    if args.command == "run":
        files.write_csv(registry.QUERIES[args.query](spark, args.input_dir), args.output_dir)
        return
    poems = spark.read.parquet(args.poems)
    chars = prosody.readings_by_char(files.read_rhymes(spark, args.rhymes), files.read_merged_classes(spark, args.merged))
    asked = poems.select(F.col("id").alias("poem_id"), F.col("cipai").alias("requested"), "content")
    found = prosody.score(asked, files.read_patterns(spark, args.patterns), chars, args.rhyme_mode == "strict")
    scored = poems.drop("rhythm_score").join(found.select(F.col("poem_id").alias("id"), F.col("score").cast("double").alias("rhythm_score")), "id", "left")
    scored.write.mode("overwrite").parquet(args.output_dir)


if __name__ == "__main__":
    main()

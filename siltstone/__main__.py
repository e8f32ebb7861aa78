"""Command line: ``python -m siltstone ingest|ask|questions|split``; each option has an environment variable of its name."""

from __future__ import annotations

import argparse
import os

#: What ends a conversation instead of asking.
STOP_WORDS = ("exit", "quit")
#: Answers that are printed; all are written.
PRINTED = 20


def parameters(argv: list[str] | None = None) -> argparse.Namespace:
    """Options from the command line, else from SILTSTONE_<NAME>, else the defaults."""
    parser = argparse.ArgumentParser(prog="siltstone", description="Corpus question answering on Spark.")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, **options) -> argparse.ArgumentParser:
        """Options by name: their defaults; ... for what must be given."""
        own = commands.add_parser(name, help=about)
        for option, default in options.items():
            given = os.environ.get(f"SILTSTONE_{option.upper()}", None if default is ... else default)
            own.add_argument(f"--{option}", default=given, required=given is None and default is ..., type=type(default) if isinstance(default, int) else str)
        return own

    ingest = command("ingest", "pages (page_id, url, html as Parquet), or a folder of *.html files, to an index", pages="", folder="", index="index", source="Knowledge Base")
    ingest.add_argument("--force", action="store_true", default=os.environ.get("SILTSTONE_FORCE", "") == "1")
    command("ask", "answers for questions, one a line of a text file; blank lines ask nothing, a stop word ends the list", index="index", questions=..., answers="answers", cache="", k=3)
    command("questions", "questions and answers from a sample of an index's chunks, as a JSON array", index="index", pairs="pairs", n=10)
    command("split", "pairs of questions and answers (a JSON array) to train, dev and test", pairs=..., out="splits")
    return parser.parse_args(argv)


def asked(spark, path: str):
    """question_id, text of the filled lines before the first stop word, each question once."""
    from pyspark.sql import functions as F

    from siltstone.functions.text import strip

    # Lines of one file are numbered in their order.
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), strip(F.col("value")).alias("text"))
    end = lines.where(F.lower("text").isin(*STOP_WORDS)).agg(F.min("n").alias("end"))
    before = lines.crossJoin(F.broadcast(end)).where(F.col("end").isNull() | (F.col("n") < F.col("end")))  # end is one row
    return before.where(F.col("text") != "").groupBy("text").agg(F.min("n").alias("n")).select(F.md5("text").alias("question_id"), "text", "n")


def run(spark, args: argparse.Namespace) -> None:
    from pyspark.sql import functions as F

    from siltstone.functions.text import preview
    from siltstone.operators import chunk, dataset, providers, search
    from siltstone.plans.ask import ask
    from siltstone.plans.ingest import index
    from siltstone.schemas import QA_PAIR
    from siltstone.sources.tables import page_folder, read_json_array, write_json_array

    if args.command == "ingest":
        if args.folder:
            files = page_folder(spark, args.folder)
            root = files.select(F.regexp_extract("path", "^([a-z0-9+.-]+:/*)?", 0)).first()
            chunks = chunk.folder_corpus(files, f"{root[0] if root else ''}{args.folder.lstrip('/')}", source=args.source)
            search.load_or_build(chunks, args.index, force=args.force)
        elif args.pages:
            index(spark.read.parquet(args.pages), args.index, force=args.force, source=args.source)
        else:
            raise SystemExit("ingest: --pages or --folder must be given")
    elif args.command == "ask":
        questions = asked(spark, args.questions)
        cache = providers.ResponseCache(spark, args.cache) if args.cache else None
        answers = ask(search.load(spark, args.index), questions.select("question_id", "text"), args.k, cache=cache)
        shown = answers.withColumn("sources", F.transform(F.slice("context", 1, args.k), lambda c: preview(c)))
        write_json_array(shown.drop("context"), args.answers)
        told = read_json_array(spark, args.answers, "question_id string, question string, answer string, sources array<string>")
        for r in told.join(questions.select("question_id", "n"), "question_id").orderBy("n").limit(PRINTED).collect():
            print("\n".join([f"Q: {r['question']}", f"A: {r['answer']}", *(f"  [{i}] {x}" for i, x in enumerate(r["sources"], 1))]))
    elif args.command == "questions":
        chunks = search.load(spark, args.index)["chunks"]
        picked = dataset.sample(dataset.valid_chunks(chunks), F.col("chunk_id"), args.n)
        pairs = picked.select("doc_id", "section", providers.question_of(F.col("section"), F.col("text")).alias("question"), providers.answer_of(F.col("text")).alias("answer"), F.col("text").alias("context"))
        write_json_array(dataset.valid_qa(pairs), args.pairs)
    else:
        pairs = read_json_array(spark, args.pairs, QA_PAIR).withColumn("pos", F.monotonically_increasing_id())
        rows = dataset.split(dataset.with_topics(pairs))
        for name in dataset.CAPS:
            write_json_array(rows.where(F.col("split") == name).orderBy("place").select("doc_id", "section", "question", "answer", "context", "inferred_topic"), f"{args.out}/{name}")


def main() -> None:
    from pyspark.sql import SparkSession

    args = parameters()
    spark = SparkSession.builder.appName("siltstone").getOrCreate()
    run(spark, args)
    spark.stop()


if __name__ == "__main__":
    main()

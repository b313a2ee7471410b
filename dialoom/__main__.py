"""Command line: ``python -m dialoom <job> ...`` (under ``spark-submit`` on a cluster)."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from dialoom.functions.text import GEMMA, LLAMA
from dialoom.functions.tokens import RegexTokenizer
from dialoom.operators.regenerate import RetryPolicy
from dialoom.plans import jobs
from dialoom.schema import CONVERSATION, SAMPLE_RATE, SEED, TRAIN_RATIO
from dialoom.sources.service import REPLY_TOKENS, TEMPERATURE, TIMEOUT_SECONDS, ChatService


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="dialoom", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    clean = commands.add_parser("clean", help="clean a JSONL corpus, whole or split")
    clean.add_argument("source")
    clean.add_argument("target")
    clean.add_argument("-f", "--full", action="store_true", help="no train/test split")
    clean.add_argument("--ratio", type=float, default=TRAIN_RATIO)
    clean.add_argument("--seed", type=int, default=SEED)
    clean.add_argument("--only-turns", action="store_true", help="drop all other keys, in one pass")

    sample = commands.add_parser("sample", help="a reproducible share of a JSONL corpus")
    sample.add_argument("source")
    sample.add_argument("target")
    sample.add_argument("-p", type=float, default=SAMPLE_RATE)
    sample.add_argument("--seed", type=int, default=SEED)

    replay = commands.add_parser("regenerate", help="replace replies by generated ones")
    replay.add_argument("--dataset", required=True)
    replay.add_argument("--format", choices=["jsonl", "json", "parquet"])
    replay.add_argument("--order", help="integer column with the order of the records; else their place in the files")
    replay.add_argument("--url", required=True)
    replay.add_argument("--model", required=True)
    replay.add_argument("--api-key")
    replay.add_argument("--output", required=True, help="folder of the saved batches")
    replay.add_argument("--temperature", type=float, default=TEMPERATURE)
    replay.add_argument("--max-tokens", type=int, default=REPLY_TOKENS)
    replay.add_argument("--timeout", type=float, default=TIMEOUT_SECONDS)
    replay.add_argument("--start-index", type=int, default=0)
    replay.add_argument("--end-index", type=int)
    replay.add_argument("--batch-save", type=int, default=10)
    replay.add_argument("--partitions", type=int, help="tasks that call the service at once")
    replay.add_argument("--threads", type=int, default=8, help="calls at once in each task")

    merge = commands.add_parser("merge", help="saved batches to one corpus")
    merge.add_argument("source")
    merge.add_argument("target")
    merge.add_argument("--keep-repeats", action="store_true")

    for name, text in (("featurize", "chats to token ids and masks"), ("vocab", "chats to a draft vocabulary")):
        made = commands.add_parser(name, help=text)
        made.add_argument("source")
        made.add_argument("target")
        made.add_argument("--format", choices=["jsonl", "json", "parquet"])
        made.add_argument("--template", choices=["llama", "gemma"], default="llama")
        made.add_argument("--vocab-size", type=int, default=RegexTokenizer().vocab_size)
        made.add_argument("--max-len", type=int, help="tokens kept of each chat; all by default")
        made.add_argument("--on-error", choices=["fail", "drop"], default="fail")
        if name == "vocab":
            made.add_argument("--draft-size", type=int, required=True)
            made.add_argument("--ties", choices=["first_seen", "token_id"], default="first_seen")

    report = commands.add_parser("report", help="a training log to a table")
    report.add_argument("log")
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.command == "clean":
        schema = {"schema": CONVERSATION} if args.only_turns else {}
        jobs.clean_and_split(
            spark, args.source, args.target, args.full, args.ratio, args.seed, **schema
        ).show()
    elif args.command == "sample":
        jobs.sample_corpus(spark, args.source, args.target, args.p, args.seed)
    elif args.command == "regenerate":
        service = ChatService(
            args.url, args.model, args.api_key, args.temperature, args.max_tokens, args.timeout
        )
        jobs.regenerate_dataset(
            spark, args.dataset, args.output, service, args.order, args.batch_save, args.format,
            start_index=args.start_index, end_index=args.end_index, policy=RetryPolicy(),
            partitions=args.partitions, threads=args.threads,
        )
    elif args.command == "merge":
        dedupe = None if args.keep_repeats else "idx"
        jobs.merge_corpus(spark, args.source, args.target, dedupe)
    elif args.command in ("featurize", "vocab"):
        template = {"llama": LLAMA, "gemma": GEMMA}[args.template]
        common = (spark, args.source, args.target, template, RegexTokenizer(vocab_size=args.vocab_size))
        options = {"max_len": args.max_len, "on_error": args.on_error, "fmt": args.format}
        if args.command == "featurize":
            jobs.feature_corpus(*common, **options)
        else:
            jobs.vocabulary_corpus(*common, args.draft_size, **options, ties=args.ties).show()
    elif args.command == "report":
        jobs.training_report(spark, args.log).orderBy("split", "epoch").show(1000)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    run(SparkSession.builder.appName("dialoom").getOrCreate(), args)


if __name__ == "__main__":
    main()

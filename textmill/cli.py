"""Command line: one text in, its compression out."""

from __future__ import annotations

import argparse
import sys

from textmill.config import ArgumentError, Budget, BudgetError, ConfigError, InputError, Options, default_config_path, load


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textmill", description="Compress a text to a token budget by leaving out segments.")
    p.add_argument("file", nargs="?", help="input; standard input if left out")
    p.add_argument("--budget", help="tokens, or a percentage like 25%%")
    p.add_argument("--model", help="take the budget from a model's context window")
    p.add_argument("--reserve", type=int, default=0, help="tokens of the window to leave free")
    p.add_argument("--preserve-head", type=int, default=0)
    p.add_argument("--preserve-tail", type=int, default=0)
    p.add_argument("--stats", action="store_true", help="statistics on standard error")
    p.add_argument("--tokenizer", choices=("openai", "anthropic", "approximate"))
    p.add_argument("--vocabulary", help="rank file for the openai tokenizer; its own vocabulary is fetched once if left out")
    for name in ("aggressive", "conservative", "no-redundancy", "no-boilerplate", "no-extractive", "preserve-code", "semantic"):
        p.add_argument(f"--{name}", action="store_true")
    p.add_argument("--config", help="TOML file")
    p.add_argument("--compat", choices=("fixed", "reference"), default="fixed")
    p.add_argument("--version", action="version", version="textmill 1")
    return p


def options_from(args: argparse.Namespace) -> Options:
    """Configuration first, then what the command line says; a budget beats a model."""
    from dataclasses import replace

    path = args.config
    if path is None and (usual := default_config_path()) and usual.exists():
        path = str(usual)
    o = load(path, Options(compat=args.compat))
    if not args.budget and not args.model and o.budget == Budget():
        raise ArgumentError("a budget or a model is needed")
    if args.reserve > 0 and not args.model:
        raise ArgumentError("--reserve needs --model")
    if args.aggressive and args.conservative:
        raise ArgumentError("--aggressive and --conservative exclude each other")
    if args.budget:
        o = replace(o, budget=Budget.parse(args.budget))
    elif args.model:
        o = replace(o, budget=Budget(model=args.model, reserve=args.reserve))
    return replace(
        o, head=args.preserve_head, tail=args.preserve_tail, tokenizer=args.tokenizer or o.tokenizer, vocabulary=args.vocabulary or o.vocabulary, aggressive=args.aggressive, conservative=args.conservative,
        redundancy=o.redundancy and not args.no_redundancy, boilerplate=o.boilerplate and not args.no_boilerplate, extractive=o.extractive and not args.no_extractive,
        preserve_code=args.preserve_code, mode="semantic" if args.semantic else o.mode,
    )


def main(argv: list[str] | None = None, spark=None) -> int:
    """Exit codes: 1 input, 2 arguments, 3 budget or model, 4 configuration."""
    from textmill.operators import stats
    from textmill.plans.pipeline import compress
    from textmill.progress import on_terminal
    from textmill.sources.contexts import from_text, read_one

    args = parser().parse_args(argv)
    try:
        options = options_from(args)
        text = read_one(args.file)
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
        done = compress(from_text(spark, text), options, on_terminal(len(text.split())))
        row = done.results.first()
        if row["status"] == "budget_error":
            raise ConfigError("the budget can't hold what is preserved")
        sys.stdout.write(row["output"] or "")
        if args.stats:
            sys.stderr.write(stats.report(done.stats).first()["report"])
        for w in done.warnings.orderBy("seg_idx").collect():  # of one text
            sys.stderr.write(f"warning: {w['kind']}: {w['preview']}\n")
        done.release()
    except (InputError, ArgumentError, BudgetError, ConfigError) as e:
        sys.stderr.write(f"error: {e}\n")
        return e.code
    return 0


if __name__ == "__main__":
    sys.exit(main())

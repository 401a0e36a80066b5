"""Command line: ``python -m spanloom.cli check | text | file | eval | serve``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.errors import PySparkException

from spanloom.operators.detect import RedactionFailed
from spanloom.plans import catalogue
from spanloom.plans.config import Config, ConfigError, load, of_regions, preferences, shipped

#: Where a person's choices and details are kept, unless said otherwise.
HOME = os.path.join(os.path.expanduser("~"), ".spanloom")


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("spanloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def chosen(args, config: Config, ask=None) -> tuple[str, list[str] | None]:
    """Context and entities: what the flags say; else the kept preference; else what a person at the terminal picks; else ``default``.

    Entities of one's own choosing are taken from the context ``everything``.
    """
    if args.entities:
        return args.context or "everything", [x for x in args.entities.split(",") if x]
    if args.context:
        return args.context, None
    kept = preferences(args.preferences)["entities"]
    if kept:
        return "everything", kept
    if ask is None:
        return "default", None
    regions = list(catalogue.CATEGORIES)
    said = ask("\n".join(f"{k}. {catalogue.CATEGORIES[r]}" for k, r in enumerate(regions, 1)) + "\nnumbers, with commas: ").strip()
    picks = [x.strip() for x in said.split(",") if x.strip()]
    if not picks or not all(x.isdigit() and 1 <= int(x) <= len(regions) for x in picks):
        return "default", None
    return "everything", of_regions(config, [regions[int(x) - 1] for x in picks])


def _check(args, config: Config) -> int:
    print(f"{len(config.entities)} entities, {len(config.patterns)} patterns, {len(config.contexts)} contexts")
    for name, c in sorted(config.contexts.items()):
        print(f"  {name}: threshold {c.threshold}, {c.strategy}, {len(c.entities)} entities")
    return 0


def _text(args, config: Config) -> int:
    from pyspark.sql import functions as F

    from spanloom.operators import identity
    from spanloom.operators.replace import redact

    text = args.text if args.text is not None else sys.stdin.read()
    context, entities = chosen(args, config, input if args.text is not None and sys.stdin.isatty() else None)
    df, keep = session().createDataFrame([(text,)], "text string"), None
    if args.who == "mine":
        df, keep = identity.with_identity(df, identity.load(args.identity)), lambda s: identity.filter_mine(s, F.col("text"), F.col("me"))
    sys.stdout.write(redact(df, config, context, entities=entities, salt=os.environ.get("SPANLOOM_HASH_SALT"), keep=keep).first().redacted)
    return 0


def _file(args, config: Config) -> int:
    from spanloom.operators import identity
    from spanloom.sources.files import redact_file

    context, entities = chosen(args, config, input if sys.stdin.isatty() else None)
    me = identity.load(args.identity) if args.who == "mine" else None
    print(redact_file(session(), args.path, args.out, config=config, context=context, who=args.who, me=me, force=args.force, entities=entities, salt=os.environ.get("SPANLOOM_HASH_SALT")))
    return 0


def _serve(args, config: Config) -> int:
    from spanloom.streaming.helper import serve

    serve(session(), config, sys.stdin, lambda x: print(x, flush=True))
    return 0


def _eval(args, config: Config) -> int:
    from pyspark.sql import functions as F

    from spanloom.operators import detect, evaluate, resolve
    from spanloom.sources.readers import checked_examples

    context, entities = chosen(args, config)
    found = resolve.prefer_specific(detect.detect(F.col("text"), config, context, entities), config)
    done = checked_examples(session(), args.path).select("source", F.col("spans").alias("gold"), found.alias("found"))
    sys.stdout.write(evaluate.report(done))
    return 0


def main(argv: list[str] | None = None) -> int:
    """0: done; 1: refused, with the reason on the error stream and nothing written."""
    top = argparse.ArgumentParser(prog="spanloom")
    top.add_argument("--config", help="a folder with taxonomy.yaml, patterns.yaml and rules.yaml")
    top.add_argument("--preferences", default=os.path.join(HOME, "preferences.yaml"))
    top.add_argument("--identity", default=os.path.join(HOME, "identity.yaml"))
    parts = top.add_subparsers(dest="command", required=True)
    for name, run in (("check", _check), ("text", _text), ("file", _file), ("eval", _eval), ("serve", _serve)):
        p = parts.add_parser(name)
        p.set_defaults(run=run)
        if name in ("text", "file", "eval"):
            p.add_argument("--context")
            p.add_argument("--entities", help="names, with commas")
        if name in ("text", "file"):
            p.add_argument("--who", choices=("everyone", "mine"), default="everyone")
        if name == "text":
            p.add_argument("text", nargs="?")
        if name == "file":
            p.add_argument("path")
            p.add_argument("out", nargs="?")
            p.add_argument("--force", action="store_true")
        if name == "eval":
            p.add_argument("path")
    args = top.parse_args(argv)
    try:
        return args.run(args, load(args.config) if args.config else shipped())
    except (ConfigError, RedactionFailed, ValueError, OSError, PySparkException) as e:
        print(f"spanloom: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())

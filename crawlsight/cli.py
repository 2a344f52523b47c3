"""Command line: run, list, init, checks, version."""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, datetime
from pathlib import Path

from crawlsight.sources import config as configs
from crawlsight.sources.config import Config, ConfigError

OK, ISSUES, USAGE, FAILED, INTERRUPTED = 0, 1, 2, 3, 130


COMMANDS = {
    "run": "audit the given sites, or all configured ones (also without the word run)",
    "list": "configured sites",
    "init": "write an example configuration",
    "checks": "all codes",
    "version": "the version",
}


def arguments(argv: list[str]) -> argparse.Namespace:
    """A command and its arguments; options and sites may stand in any order."""
    if argv and argv[0] in ("help", "-h", "--help"):
        print("usage: crawlsight COMMAND ...\n\n" + "\n".join(f"  {name:8} {what}" for name, what in COMMANDS.items()))
        raise SystemExit(0)
    command, rest = (argv[0], argv[1:]) if argv and argv[0] in COMMANDS else ("run", argv)
    parser = argparse.ArgumentParser(prog=f"crawlsight {command}", description=COMMANDS[command])
    if command in ("run", "list"):
        parser.add_argument("--config", help="YAML file")
    if command == "run":
        parser.add_argument("sites", nargs="*", help="ids or URLs")
        parser.add_argument("--responses", help="captured responses (Parquet) instead of fetching")
        parser.add_argument("--capture-to", help="where fetched responses are written, and stay; in the work folder by default")
        parser.add_argument("--work", help="folder of tables between stages, shared by all machines; spark.checkpoint.dir by default")
        parser.add_argument("--out", help="folder of the reports")
        parser.add_argument("--format", help=f"formats, separated by commas: {', '.join(configs.FORMATS)}")
        parser.add_argument("--fail-on", help="none, notice, warning or error")
        parser.add_argument("--no-crawl", action="store_true", help="robots.txt and sitemaps only")
        parser.add_argument("--max-urls", type=int)
        parser.add_argument("--concurrency", type=int)
    elif command == "init":
        parser.add_argument("file", nargs="?", default=configs.FILES[0])
        parser.add_argument("--force", action="store_true")
    elif command == "checks":
        parser.add_argument("--markdown", action="store_true")
    args = parser.parse_intermixed_args(rest)
    args.command = command
    return args


def load(path: str | None) -> Config:
    found = Path(path) if path else configs.find_default()
    return configs.load(found) if found else Config()


def changed(config: Config, args: argparse.Namespace) -> Config:
    """The configuration with what the command line says in its place, checked again."""
    given = {
        "report": {"out": args.out, "fail_on": args.fail_on, "formats": args.format and args.format.split(",")},
        "crawl": {"enabled": False if args.no_crawl else None, "max_urls": args.max_urls, "concurrency": args.concurrency},
    }
    for part, values in given.items():
        for name, value in values.items():
            if value not in (None, ""):
                setattr(getattr(config, part), name, value)
    if errors := config.errors():
        raise ConfigError("\n".join(errors))
    return config


def run(args: argparse.Namespace, config: Config) -> int:
    from crawlsight import session, storage
    from crawlsight.plans import audit, reports
    from crawlsight.sources import live, schemas

    config = changed(config, args)
    chosen, started = config.select(args.sites), datetime.now(UTC)
    spark = session.build()
    with storage.work_folder(spark, args.work):
        at = args.responses or args.capture_to or storage.shared_path(spark, "responses")
        if not args.responses:
            fetched = live.capture(spark, config, [s.url for s in chosen])
            fetched.write.mode("overwrite").partitionBy("site_id").parquet(at)
        sites = schemas.site_rows(spark, [s.url for s in chosen])
        everything = schemas.site_rows(spark, [s.url for s in config.sites]) if config.sites else None
        found = audit.audit(schemas.responses(spark, at), sites, config, started, everything)
        found.urls, found.sites, found.excluded = (storage.written(x, "report") for x in (found.urls, found.sites, found.excluded))
        folder = reports.run_dir(config.report.out, started)
        files, errors = reports.write(found, folder, config.report.formats, config.report.csv_bom, config.report.fail_on)
        reports.mark_latest(config.report.out, folder)
        print(reports.console(found))
        print("\n".join(map(str, files)))
        for error in errors:
            print(f"error: {error}", file=sys.stderr)
        return FAILED if errors else audit.exit_code(found)


def main(argv: list[str] | None = None) -> int:
    """Exit code: 0, 1 for issues as bad as fail_on, 2 for wrong usage, 3 for a failure, 130 when interrupted."""
    from crawlsight.operators.catalogue import CATALOGUE

    try:
        args = arguments(sys.argv[1:] if argv is None else argv)
    except SystemExit as e:
        return USAGE if e.code else OK
    try:
        if args.command == "version":
            from crawlsight.plans.reports import VERSION

            print(f"crawlsight {VERSION}")
        elif args.command == "checks":
            from crawlsight.plans.reports import catalogue_markdown

            print(catalogue_markdown() if args.markdown else "\n".join(f"{d.code:28} {d.severity:8} {d.group:17} {d.title}" for d in CATALOGUE))
        elif args.command == "init":
            if Path(args.file).exists() and not args.force:
                raise ConfigError(f"{args.file} exists (use --force to overwrite it)")
            Path(args.file).write_text(configs.example())
            print(f"wrote {args.file}")
        elif args.command == "list":
            config = load(args.config)
            print("\n".join(f"{s.id:40} {s.url}" for s in config.sites) or "no sites configured")
        else:
            return run(args, load(args.config))
    except ConfigError as e:
        print(f"error: {e}", file=sys.stderr)
        return USAGE
    except KeyboardInterrupt:
        return INTERRUPTED
    return OK

"""Contract commands: ``python -m tidemark.functions check|ddl|avro FOLDER [--out DIR] [--check]``."""

from __future__ import annotations

import argparse
import sys

from tidemark.functions import schemas
from tidemark.functions.contracts import ContractError, check_all, latest_contracts, load_contracts


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Check contracts and write what is generated from them.")
    parser.add_argument("command", choices=["check", "ddl", "avro"])
    parser.add_argument("folder")
    parser.add_argument("--out")
    parser.add_argument("--check", action="store_true", help="report missing, stale and unexpected files instead of writing")
    args = parser.parse_args(argv)
    try:
        contracts = load_contracts(args.folder)
    except ContractError as e:
        print(e, file=sys.stderr)
        return 1
    if problems := check_all(contracts):
        print("\n".join(problems), file=sys.stderr)
        return 1
    if args.command == "check":
        print(f"{len(contracts)} contracts are valid and compatible")
        return 0
    if args.command == "ddl":
        files, pattern = {f"generated_{c['name']}.sql": schemas.raw_ddl(c) for c in latest_contracts(contracts)}, "generated_*.sql"
    else:
        files, pattern = schemas.schema_files(contracts), "*.avsc"
    if not args.out:
        print("\n".join(files[n] for n in sorted(files)))
        return 0
    if args.check:
        found = schemas.check_files(files, args.out, pattern)
        print("\n".join(found) or "up to date")
        return int(bool(found))
    schemas.write_files(files, args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""python -m assayer load -d FOLDER... -s SCHEMA; python -m assayer validate -d FOLDER... -s SCHEMA -i INPUT -t TYPE"""

from __future__ import annotations

import argparse
import sys

from assayer.functions.ion import IonError
from assayer.functions.ionbinary import read_any
from assayer.operators.interpret import validate
from assayer.plans.model import to_isl
from assayer.plans.system import FileAuthority, SchemaSystem, UnresolvableSchemaError


def _report(path: str, type_, schema_id: str) -> int:
    bad = 0
    with open(path, "rb") as f:
        for value in read_any(f.read()):
            found = validate(value, type_)
            bad += found is not None
            print(f"{value} of {schema_id}: {'Invalid' if found else 'Valid'}")
            if found:
                print(found.tree(1))
    return bad


def main(args: list[str] | None = None) -> int:
    """0: loaded, or all values valid; 1: some aren't; 2: the schema or the input can't be read."""
    parser = argparse.ArgumentParser(prog="assayer", description="Loads schemas and validates files of Ion values.")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("load", "validate"):
        p = commands.add_parser(name)
        p.add_argument("-d", "--directory", action="append", default=[], help="where schemas are; may be given again")
        p.add_argument("-s", "--schema", required=True, help="the id of the schema")
        if name == "validate":
            p.add_argument("-i", "--input", required=True, help="a file of Ion values")
            p.add_argument("-t", "--type", required=True, help="the type that they should be of")
    given = parser.parse_args(args)
    try:
        schema = SchemaSystem(map(FileAuthority, given.directory or ["."])).load_schema(given.schema)
        if given.command == "load":
            print(to_isl(schema.isl))
            return 0
        return int(_report(given.input, schema[given.type], given.schema) > 0)
    except (IonError, ValueError, UnresolvableSchemaError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())

"""python -m sparkloom QUERY SF_DIR [--out PATH]: runs a query of the catalogue and shows, or writes as Parquet, its rows."""

from __future__ import annotations

import argparse

from sparkloom import catalogue
from sparkloom.session import local_session


def main() -> None:
    parser = argparse.ArgumentParser(prog="sparkloom")
    parser.add_argument("query", choices=sorted(catalogue.queries()))
    parser.add_argument("sf_dir")
    parser.add_argument("--out")
    args = parser.parse_args()
    df = catalogue.queries()[args.query](local_session(), args.sf_dir)
    if args.out:
        df.write.parquet(args.out)
    else:
        df.show(truncate=False)


if __name__ == "__main__":
    main()

"""``python -m tidepanel.cli STAGE --data FOLDER --out FOLDER [--config FILE]``"""

from __future__ import annotations

import argparse
import json

STAGES = ("audit", "prepare", "pilot", "full", "suite", "finalize")


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidepanel")
    parser.add_argument("stage", choices=STAGES)
    parser.add_argument("--data", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--config", help="JSON file of settings that differ from the defaults")
    chosen = parser.parse_args(args)
    from tidepanel.plans.run import Run
    from tidepanel.session import session

    overrides = {}
    if chosen.config:
        with open(chosen.config) as f:
            overrides = json.load(f)
    getattr(Run(session(), chosen.data, chosen.out, overrides), chosen.stage)().show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

"""Command line of the dataset stages."""

from __future__ import annotations

import argparse
import inspect

from pyspark.sql import SparkSession

from . import stages

STAGES = {
    "physical-map": stages.physical_map, "semantic-map": stages.semantic_map, "scene-text": stages.scene_text, "trajectories": stages.trajectories,
    "to-scene": stages.to_scene, "merge": stages.merge, "statistics": stages.statistics, "split": stages.split, "extract": stages.extract,
    "actions": stages.actions, "images": stages.images, "training": stages.training, "episodes": stages.episode_files, "evaluate": stages.evaluate,
    "scene-files": stages.scene_files,
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="waymark", description=__doc__)
    sub = top.add_subparsers(dest="stage", required=True)
    for name, f in STAGES.items():
        one = sub.add_parser(name, help=(f.__doc__ or "").split("\n")[0])
        for p in list(inspect.signature(f).parameters.values())[1:]:
            flag = "--" + p.name.replace("_", "-")
            if p.default is inspect.Parameter.empty:
                one.add_argument(flag, required=True)
            elif p.default is False:
                one.add_argument(flag, action="store_true")
            elif "list" in str(p.annotation):
                one.add_argument(flag, nargs="*")
            else:
                kind = int if "int" in str(p.annotation) else float if "float" in str(p.annotation) else str
                one.add_argument(flag, type=kind, default=p.default)
    return top


def main(argv: list[str] | None = None) -> None:
    given = vars(parser().parse_args(argv))
    stage = STAGES[given.pop("stage")]
    shown = stage(SparkSession.builder.appName("waymark").getOrCreate(), **given)
    if shown is not None:  # a manifest, or what is still to be made
        shown.show(20, truncate=False)


if __name__ == "__main__":
    main()

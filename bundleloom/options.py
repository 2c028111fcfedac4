"""Settings: built-in defaults < YAML leaves that are present < explicit command line < skip aliases."""

from __future__ import annotations

import argparse
import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Options:
    """Resolved settings; frozen, so they can be captured by tasks."""

    out: str = "pack.zip"
    threads: int = os.cpu_count() or 1
    quiet: bool = False
    verbose: bool = False
    dry_run: bool = False
    no_progress: bool = False
    json_minify: bool = True
    png_recompress: bool = True
    png_strip_meta: bool = True
    png_level: int = 0
    png_keep_color_profile: bool = False
    png_lossy: bool = True
    png_quant_min: int = 65
    png_quant_max: int = 90
    png_protect_alpha: bool = True
    ogg_optimize: bool = True
    ogg_strip_comments: bool = True
    text_minify: bool = True
    #: "deflate_all" compresses every body; "hint" keeps the store hint of media results.
    store_policy: str = "deflate_all"
    #: "shared" lets equal files share one body; "off" writes a body for each, for strict readers.
    dedup: str = "shared"
    #: Notes of the palette pass (left out for transparency, failed); without it they are not told.
    media_notes: bool = False


# Where each setting stands in the YAML file.
YAML_LEAVES = {
    ("out",): "out", ("threads",): "threads", ("quiet",): "quiet", ("verbose",): "verbose", ("dry_run",): "dry_run",
    ("no_progress",): "no_progress", ("json", "minify"): "json_minify", ("png", "recompress"): "png_recompress",
    ("png", "strip_meta"): "png_strip_meta", ("png", "level"): "png_level", ("png", "keep_color_profile"): "png_keep_color_profile",
    ("png", "lossy_quant"): "png_lossy", ("png", "quant_min"): "png_quant_min", ("png", "quant_max"): "png_quant_max",
    ("png", "protect_alpha"): "png_protect_alpha", ("ogg", "optimize"): "ogg_optimize",
    ("ogg", "strip_comments"): "ogg_strip_comments", ("text", "minify"): "text_minify",
}
#: Top-level switches that a file can only turn on.
ONLY_ON = ("quiet", "verbose", "dry_run", "no_progress")

FLAGS = {
    "out": str, "threads": int, "q": bool, "v": bool, "dry-run": bool, "no-progress": bool, "json-minify": bool,
    "png-recompress": bool, "png-strip-meta": bool, "png-level": int, "png-keep-color-profile": bool, "png-lossy": bool,
    "png-quant-min": int, "png-quant-max": int, "png-protect-alpha": bool, "ogg": bool, "ogg-strip-comments": bool, "text-minify": bool,
}
NAMES = {"q": "quiet", "v": "verbose", "ogg": "ogg_optimize"}
#: Aliases and the settings they clear.  Skipping PNG leaves the lossy pass on.
SKIPS = {
    "skip-json": ("json_minify",), "skip-png": ("png_recompress", "png_strip_meta"), "skip-png-quant": ("png_lossy",),
    "skip-ogg": ("ogg_optimize",), "skip-text": ("text_minify",),
}


def overlay(base: Options, tree: dict | None) -> Options:
    """``base`` with the leaves that ``tree`` holds; null leaves and unknown keys change nothing."""
    given = {}
    for path, name in YAML_LEAVES.items():
        at = tree or {}
        for key in path:
            at = at.get(key) if isinstance(at, dict) else None
        if at is None:
            continue
        if name == "threads" and int(at) <= 0 or name == "out" and not at:
            continue
        given[name] = getattr(base, name) or bool(at) if name in ONLY_ON else at
    return replace(base, **given)


def read_yaml(path: str) -> dict:
    """The mapping in a YAML file; a missing path or a file that isn't a mapping is an error."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading a settings file needs the yaml module") from e
    with open(path, encoding="utf-8") as f:
        tree = yaml.safe_load(f)
    if tree is not None and not isinstance(tree, dict):
        raise ValueError(f"{path}: settings must be a mapping")
    return tree or {}


def _truth(text: str) -> bool:
    if text.lower() in ("1", "t", "true"):
        return True
    if text.lower() in ("0", "f", "false"):
        return False
    raise argparse.ArgumentTypeError(f"not a truth value: {text!r}")


def parser() -> argparse.ArgumentParser:
    """Single-dash long options, in any order with the positionals; only options given are set."""
    p = argparse.ArgumentParser(prog="bundleloom", allow_abbrev=False, argument_default=argparse.SUPPRESS)
    p.add_argument("input", nargs="*", default=[])
    p.add_argument("-config", "--config")
    for flag, kind in FLAGS.items():
        name = NAMES.get(flag, flag.replace("-", "_"))
        more = {"nargs": "?", "const": True, "type": _truth} if kind is bool else {"type": kind}
        p.add_argument(f"-{flag}", f"--{flag}", dest=name, **more)
    for flag in SKIPS:
        p.add_argument(f"-{flag}", f"--{flag}", dest=flag, nargs="?", const=True, type=_truth)
    return p


def _with_equals(argv: list[str]) -> list[str]:
    """Truth options take a value only after ``=``, so a positional that follows one stays a positional."""
    truth = {f for f, k in FLAGS.items() if k is bool} | set(SKIPS)
    out = []
    for a in argv:
        name, eq, _ = a.lstrip("-").partition("=")
        out.append(f"{a}=true" if a.startswith("-") and name in truth and not eq else a)
    return out


def resolve(argv: list[str], folder: str = ".") -> tuple[str | None, Options]:
    """(input path or None, settings) of a command line."""
    given = vars(parser().parse_intermixed_args(_with_equals(argv)))
    inputs, path = given.pop("input"), given.pop("config", None)
    auto = os.path.join(folder, "config.yml")
    tree = read_yaml(path) if path else read_yaml(auto) if os.path.exists(auto) else {}
    out = overlay(Options(), tree)
    known = {f.name for f in fields(Options)}
    out = replace(out, **{k: v for k, v in given.items() if k in known})
    for flag, cleared in SKIPS.items():
        if given.get(flag):
            out = replace(out, **dict.fromkeys(cleared, False))
    return (inputs[0] if inputs else None), replace(out, threads=max(1, out.threads))

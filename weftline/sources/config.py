"""Configuration, and files that are looked for in several places. All of it runs on the driver."""

from __future__ import annotations

import logging
import os
import shutil
import tomllib
from dataclasses import asdict, dataclass, fields
from pathlib import Path

log = logging.getLogger(__name__)


@dataclass
class AppConfig:
    output_format: str = "mp4"
    gguf_model_path: str | None = None
    ffmpeg_path: str | None = None
    vad_threshold_db: str | None = None
    sherpa_onnx_dir: str | None = None


#: One default for the detector's threshold, in dB.
DEFAULT_THRESHOLD = "-40"


def config_file(home: str | None = None) -> Path:
    """Its folder is made when it is asked for."""
    folder = Path(home or os.path.expanduser("~")) / ".weftline"
    folder.mkdir(parents=True, exist_ok=True)
    return folder / "config.toml"


def load_config(path: Path) -> AppConfig:
    """The defaults, also written, where there is no file; the defaults, with a warning, where it can't be read or lacks the
    required field."""
    if not path.exists():
        save_config(path, held := AppConfig())
        return held
    try:
        raw = tomllib.loads(path.read_text())
        names = {f.name for f in fields(AppConfig)}
        if not isinstance(raw["output_format"], str):
            raise TypeError("output_format")
        return AppConfig(**{k: v for k, v in raw.items() if k in names})
    except (OSError, tomllib.TOMLDecodeError, KeyError, TypeError, UnicodeDecodeError) as e:
        log.warning("%s can't be read (%s); defaults are used", path, e)
        return AppConfig()


def save_config(path: Path, config: AppConfig) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    path.write_text("".join(f"{k} = {quote(v)}\n" for k, v in asdict(config).items() if v is not None))


def merged(request: dict[str, str | None], config: AppConfig) -> AppConfig:
    """The recogniser's folder from the request, else the config; translator and threshold from the request only; the
    media tool from the config only."""
    threshold = request.get("vad_threshold_db") or DEFAULT_THRESHOLD
    return AppConfig(request.get("output_format") or config.output_format, request.get("gguf_model_path"), config.ffmpeg_path, threshold, request.get("sherpa_onnx_dir") or config.sherpa_onnx_dir)


def resolve_input(path: str) -> str:
    """The path, or <parent>/test/<name> where only that exists."""
    p = Path(path)
    other = p.parent / "test" / p.name
    return str(other) if not p.exists() and other.exists() else path


def missing_settings(config: AppConfig, input_path: str | None) -> list[str]:
    """What a run needs and does not have: a video, the translator's model, the recogniser's folder."""
    have = {"input_path": input_path, "gguf_model_path": config.gguf_model_path, "sherpa_onnx_dir": config.sherpa_onnx_dir}
    return [name for name, value in have.items() if not value]


def model_file(folder: str, name: str) -> Path | None:
    """<name>.int8.onnx before <name>.onnx."""
    return next((p for p in (Path(folder) / f"{name}{end}" for end in (".int8.onnx", ".onnx")) if p.exists()), None)


def model_folder(configured: str | None, candidates: tuple[str, ...] = ()) -> str | None:
    """The first folder that has an encoder; else the configured one anyway."""
    return next((d for d in (configured, *candidates) if d and model_file(d, "encoder")), configured)


def media_tool(configured: str | None, name: str = "ffmpeg") -> str:
    """Configured, beside the interpreter's program, in the working folder, on the path, or the bare name."""
    import sys

    places = [configured, Path(sys.argv[0]).parent / name, Path(name).absolute()]
    return next((str(p) for p in places if p and Path(p).exists()), None) or shutil.which(name) or name


def log_paths(folders: list[str]) -> list[Path]:
    """One log file a folder, in order, each once."""
    return list(dict.fromkeys(Path(f) / "weftline.log" for f in folders))


def append_log(paths: list[Path], line: str) -> None:
    """To every file that can be written."""
    for p in paths:
        try:
            p.parent.mkdir(parents=True, exist_ok=True)
            with p.open("a") as f:
                f.write(line + "\n")
        except OSError:
            continue

"""Settings: one flat record, read from and written to simple YAML, and what can be found out about a project without it."""

from __future__ import annotations

import json
import os
import re
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path

MODES = ("Full", "Snapshot", "Manual")
PROVIDERS = ("sqlserver", "oracle", "mysql", "postgresql")


@dataclass(frozen=True)
class Config:
    """Keys of the file are these names in PascalCase."""

    connection_string: str | None = None
    ground_truth_mode: str = "Snapshot"
    snapshot_file_path: str | None = None
    baseline_file_path: str | None = None
    naming_convention: str = "SnakeCaseToPascalCase"
    enable_baseline: bool = True
    excluded_procedures: tuple[str, ...] = ()
    excluded_entities: tuple[str, ...] = ()
    max_violation_queue_size: int = 100_000
    enable_audit_logging: bool = True
    audit_log_path: str | None = None
    manual_contract_path: str | None = None
    auto_detect_provider: bool = True
    default_schema: str | None = None
    default_package: str | None = None
    enable_telemetry: bool = False
    provider: str | None = None


def _key(name: str) -> str:
    return "".join(p.capitalize() for p in name.split("_"))


def _scalar(text: str):
    """A YAML scalar: quoted text, true or false, a whole number, null, or plain text without its comment."""
    text = text.strip()
    if text[:1] in ("'", '"') and text[0] in text[1:]:
        return text[1 : text.index(text[0], 1)]
    text = re.sub(r"\s+#.*$", "", text).strip()
    if text in ("", "~", "null") or text.startswith("#"):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    return int(text) if re.fullmatch(r"-?\d+", text) else text


def parse_config(yaml: str) -> Config:
    """Top-level scalars and lists of scalars; keys that aren't known, and nested blocks, are passed over. A value that doesn't fit its key's type is an error."""
    values: dict[str, object] = {}
    current = None
    for line in yaml.splitlines():
        item = re.match(r"\s*-\s+(.*)$", line)
        if item and current:
            values.setdefault(current, [])
            if isinstance(values[current], list):
                values[current].append(_scalar(item[1]))
            continue
        pair = re.match(r"([A-Za-z]\w*)\s*:(.*)$", line)
        if pair:
            current, value = pair[1], pair[2].strip()
            inline = re.fullmatch(r"\[(.*)\]\s*(#.*)?", value)
            if inline:
                values[current] = [_scalar(x) for x in inline[1].split(",") if x.strip()]
            elif value:
                values[current] = _scalar(value)
    found = {}
    for f in fields(Config):
        key = _key(f.name)
        if key not in values or values[key] is None:
            continue
        value = values[key]
        wanted = bool if f.type == "bool" else int if f.type == "int" else tuple if f.type.startswith("tuple") else str
        if wanted is tuple:
            value = tuple(map(str, value)) if isinstance(value, list) else (str(value),)
        elif wanted is str:
            value = str(value)
        if type(value) is not wanted:
            raise ValueError(f"{key}: {value!r} isn't of type {wanted.__name__}")
        found[f.name] = value
    config = Config(**found)
    if config.ground_truth_mode not in MODES:
        raise ValueError(f"GroundTruthMode: one of {', '.join(MODES)}")
    return config


def load_config(path: str | None) -> Config:
    """The file's settings; those of no file are the defaults."""
    return parse_config(Path(path).read_text()) if path and Path(path).exists() else Config()


def dump_config(config: Config) -> str:
    """YAML that ``parse_config`` reads back."""
    out = []
    for name, value in asdict(config).items():
        if value is None or value == ():
            continue
        if isinstance(value, tuple):
            out += [f"{_key(name)}:", *(f"  - {json.dumps(v)}" for v in value)]
        else:
            out.append(f"{_key(name)}: {json.dumps(value)}")
    return "\n".join(out) + "\n"


def contained_path(workspace: str, configured: str) -> Path:
    """A configured path inside the workspace; absolute ones, and ones that lead out of it, are errors."""
    if Path(configured).is_absolute():
        raise ValueError("the path must be relative to the workspace folder")
    base, found = Path(os.path.abspath(workspace)), Path(os.path.abspath(Path(workspace) / configured))
    if found != base and base not in found.parents:
        raise ValueError("the path must remain inside the workspace folder")
    return found


# ---------------------------------------------------------------- what a project says


def provider_of_connection(connection: str | None) -> str | None:
    """Oracle's signs are looked for first, since its strings can hold a data source too."""
    text = (connection or "").lower()
    if any(w in text for w in ("oracle", "service_name", "connect_data")) or ("user id" in text and "password" in text):
        return "oracle"
    return "sqlserver" if any(w in text for w in ("data source", "server=", "server =")) else None


def _strings(settings: str) -> tuple[list[str], bool]:
    try:
        root = json.loads(settings)
    except ValueError:
        return [], False
    found = root.get("ConnectionStrings") if isinstance(root, dict) else None
    return [v for v in found.values() if isinstance(v, str)] if isinstance(found, dict) else [], True


def provider_of_settings(settings: str) -> str | None:
    """By the connection strings of a settings file, in their order, else by any mention in it."""
    strings, valid = _strings(settings)
    if not valid:
        return None
    for value in map(str.lower, strings):
        if any(w in value for w in ("sqlserver", "sql server", "mssql")):
            return "sqlserver"
        if "oracle" in value:
            return "oracle"
    whole = settings.lower()
    return "sqlserver" if "sqlserver" in whole else "oracle" if "oracle" in whole else None


def _yaml_value(yaml: str, key: str) -> str | None:
    for line in yaml.splitlines():
        if line.strip().lower().startswith(f"{key.lower()}:"):
            return line.strip().split(":", 1)[1].strip().strip("\"'") or None
    return None


SETTINGS = ("appsettings.json", "appsettings.Development.json")
CONFIG_FILE = ".covenant.yml"


def detect_provider(folder: str, environment: dict[str, str] | None = None) -> str | None:
    """From the settings files, then the configuration file, then the environment."""
    environment = os.environ if environment is None else environment
    for name in SETTINGS:
        path = Path(folder) / name
        if path.exists() and (found := provider_of_settings(path.read_text())):
            return found
    config = Path(folder) / CONFIG_FILE
    for value in (_yaml_value(config.read_text(), "provider") if config.exists() else None, environment.get("COVENANT_PROVIDER")):
        if value and value.lower() in PROVIDERS:
            return value.lower()
    return None


def detect_connection(folder: str, environment: dict[str, str] | None = None) -> str | None:
    """From the environment, then the settings files' first string that names a server, then the configuration file."""
    environment = os.environ if environment is None else environment
    for name in ("COVENANT_CONNECTION_STRING", "ConnectionStrings__DefaultConnection", "ConnectionStrings__Default"):
        if name in environment:
            if environment[name]:
                return environment[name]
            break
    for name in SETTINGS:
        path = Path(folder) / name
        if path.exists():
            for value in _strings(path.read_text())[0]:
                if "server=" in value.lower() or "data source=" in value.lower():
                    return value
    config = Path(folder) / CONFIG_FILE
    return _yaml_value(config.read_text(), "connectionString") if config.exists() else None


def resolved(config: Config, folder: str, environment: dict[str, str] | None = None) -> Config:
    """``config`` with what it leaves open found out: the connection, and the provider by the connection or the project."""
    connection = config.connection_string or detect_connection(folder, environment)
    provider = config.provider or (detect_provider(folder, environment) if config.auto_detect_provider else None) or provider_of_connection(connection)
    return replace(config, connection_string=connection, provider=provider)

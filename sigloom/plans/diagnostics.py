"""All that is wrong with a program, phase by phase: parsing, prototypes, schema, semantics."""

from __future__ import annotations

import json

from sigloom.plans import program as P

# The codes, by phase.
CODES = (
    "INVALID_JSON", "UNKNOWN_PROTOTYPE", "UNKNOWN_PARAMETER", "MISSING_PARAMETER", "INVALID_PARAMETER_TYPE", "UNKNOWN_PARAM_REFERENCE", "SCHEMA_VALIDATION", "UNKNOWN_OPERATOR_TYPE", "INVALID_PORT_TYPE",
    "INVALID_PARAMETER_VALUE", "MISSING_REQUIRED_FIELD", "INVALID_OPERATOR_REF", "PORT_INDEX_OUT_OF_BOUNDS", "PORT_TYPE_MISMATCH", "INVALID_ENTRY_OPERATOR", "ENTRY_PORT_MISMATCH", "MISSING_OUTPUT_FIELD", "INVALID_OUTPUT_MAPPING",
)

HINTS = {
    "INVALID_JSON": "Give one JSON object", "UNKNOWN_OPERATOR_TYPE": "One of: " + ", ".join(sorted(P.REQUIRED)), "INVALID_PORT_TYPE": "One of: " + ", ".join(P.PORT_TYPES), "PORT_TYPE_MISMATCH": "Put a converting operator between them",
    "PORT_INDEX_OUT_OF_BOUNDS": "Ports are i1, i2, ..., c1, ... and o1, ...", "MISSING_OUTPUT_FIELD": 'Name outputs as {"operator": ["o1"]}',
}


def _entry(code: str, path: str, message: str) -> dict:
    out = {"severity": "error", "path": path, "message": message, "code": code}
    return out | ({"suggestion": HINTS[code]} if code in HINTS else {})


def diagnose(text: str | dict) -> dict:
    """{valid, errors}: each error with severity, path (a JSON pointer), message, code and perhaps a suggestion."""
    errors: list[dict] = []

    def done() -> dict:
        return {"valid": not errors, "errors": errors}

    def note(wrong: P.ProgramError, prefix: str = "") -> None:
        errors.append(_entry(wrong.code, prefix + wrong.path, str(wrong)))

    if isinstance(text, str):
        try:
            text = json.loads(text)
        except json.JSONDecodeError as wrong:
            errors.append(_entry("INVALID_JSON", "", f"this is no JSON: {wrong}"))
            return done()
    if not isinstance(text, dict) or not isinstance(text.get("operators"), list):
        errors.append(_entry("SCHEMA_VALIDATION", "/operators", "a program is an object with a list of operators"))
        return done()
    known = text.get("prototypes") or {}
    for i, op in enumerate(text["operators"]):
        proto = op.get("prototype") if isinstance(op, dict) else None
        if proto is None:
            continue
        if isinstance(proto, str) and proto not in known:
            errors.append(_entry("UNKNOWN_PROTOTYPE", f"/operators/{i}/prototype", f"no prototype is called {proto!r}"))
            continue
        proto = known[proto] if isinstance(proto, str) else proto
        given, names = op.get("parameters", {}), {p["name"]: p for p in proto.get("parameters", [])}
        for name, v in given.items():
            if name not in names:
                errors.append(_entry("UNKNOWN_PARAMETER", f"/operators/{i}/parameters/{name}", f"{op.get('id')} gives {name!r}, which its prototype doesn't take"))
            elif not P.fits(names[name]["type"], v):
                errors.append(_entry("INVALID_PARAMETER_TYPE", f"/operators/{i}/parameters/{name}", f"{op.get('id')} gives {name!r} as something else than a {names[name]['type']}"))
        for name, p in names.items():
            if name not in given and p.get("default") is None:
                errors.append(_entry("MISSING_PARAMETER", f"/operators/{i}/parameters", f"{op.get('id')} doesn't give {name!r}, which has no default"))
    if errors:
        return done()
    try:
        full = P.expand(text)
    except P.ProgramError as wrong:
        note(wrong)
        return done()
    for name, kind in (("operators", list), ("connections", list), ("output", dict)):
        if name in full and not isinstance(full[name], kind):
            errors.append(_entry("SCHEMA_VALIDATION", f"/{name}", f"{name} must be a {kind.__name__}"))
    for i, op in enumerate(full["operators"]):
        if not isinstance(op, dict):
            errors.append(_entry("SCHEMA_VALIDATION", f"/operators/{i}", "an operator is an object"))
    if errors:
        return done()
    seen: dict[str, dict] = {}
    for i, op in enumerate(full["operators"]):
        try:
            P.check_operator(op)
            seen[str(op["id"])] = op
        except P.ProgramError as wrong:
            note(wrong, f"/operators/{i}")
    if not errors:
        for i, c in enumerate(full.get("connections", [])):
            try:
                P.Graph(list(seen.values()), [P.edge_of(c)], next(iter(seen), ""), []).check()
            except P.ProgramError as wrong:
                tail = wrong.path.removeprefix("/connections/0")
                errors.append(_entry(wrong.code, f"/connections/{i}{tail}", str(wrong)))
    entry = full.get("entryOperator")
    if not entry:
        errors.append(_entry("MISSING_REQUIRED_FIELD", "/entryOperator", "entryOperator is missing"))
    elif not any(op.get("id") == entry for op in full["operators"]):
        errors.append(_entry("INVALID_ENTRY_OPERATOR", "/entryOperator", f"the entry {entry!r} is not among the operators"))
    if not full.get("output"):
        errors.append(_entry("MISSING_OUTPUT_FIELD", "/output", "output is missing"))
    for name, own in (full.get("output") or {}).items():
        if not any(op.get("id") == name for op in full["operators"]):
            errors.append(_entry("INVALID_OUTPUT_MAPPING", f"/output/{name}", f"an output names {name!r}, which is not there"))
            continue
        for p in own:
            try:
                index = P.port_number(p)[1]
                if name in seen and index >= len(P.ports(seen[name]).out):
                    errors.append(_entry("INVALID_OUTPUT_MAPPING", f"/output/{name}", f"{name} has no output {p} to give"))
            except P.ProgramError:
                errors.append(_entry("INVALID_OUTPUT_MAPPING", f"/output/{name}", f"{p!r} names no port: i1, c1, o1 and so on do"))
    return done()


def validate(text: str | dict) -> dict:
    """{valid, error} of a whole program."""
    found = diagnose(text)
    return {"valid": found["valid"], "error": "" if found["valid"] else found["errors"][0]["message"]}


def validate_operator(kind: str, spec: str | dict) -> dict:
    """{valid, error} of one operator."""
    try:
        spec = json.loads(spec) if isinstance(spec, str) else spec
        P.check_operator({"id": "operator", **spec, "type": kind})
    except (ValueError, TypeError, KeyError) as wrong:
        return {"valid": False, "error": str(wrong)}
    return {"valid": True, "error": ""}

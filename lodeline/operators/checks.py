"""Checks of reports and artifacts: a small expression language, numbers in prose, findings, gates."""

from __future__ import annotations

import ast
import operator
import re
from dataclasses import dataclass, field

from .prepare import Refused

_BIN = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod}
_CMP = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.In: lambda a, b: a in b, ast.NotIn: lambda a, b: a not in b}
_FUNCTIONS = {"len": len, "sum": sum, "min": min, "max": max, "abs": abs, "round": round, "any": any, "all": all, "sorted": sorted, "set": set, "float": float, "int": int, "str": str, "bool": bool, "list": list, "keys": lambda d: list(d), "values": lambda d: list(d.values()), "get": lambda d, k, x=None: d.get(k, x)}
MOST_STEPS = 100_000


def evaluate(expression: str, artifacts: dict) -> object:
    """A boolean or numeric expression over JSON artifacts: arithmetic, comparison, and/or/not, subscripts, one comprehension, listed functions."""
    tree = ast.parse(expression, mode="eval")
    if sum(isinstance(n, (ast.ListComp, ast.GeneratorExp, ast.SetComp)) for n in ast.walk(tree)) > 1:
        raise Refused("at most one comprehension")
    steps = 0

    def run(n: ast.AST, env: dict) -> object:
        nonlocal steps
        steps += 1
        if steps > MOST_STEPS:
            raise Refused("too many steps")
        match n:
            case ast.Expression(body=b):
                return run(b, env)
            case ast.Constant(value=v) if isinstance(v, (int, float, str, bool, type(None))):
                return v
            case ast.Name(id=i):
                if i in env:
                    return env[i]
                raise Refused(f"unknown name {i!r}")
            case ast.BinOp(left=a, op=o, right=b) if type(o) in _BIN:
                return _BIN[type(o)](run(a, env), run(b, env))
            case ast.UnaryOp(op=ast.USub(), operand=a):
                return -run(a, env)
            case ast.UnaryOp(op=ast.Not(), operand=a):
                return not run(a, env)
            case ast.BoolOp(op=o, values=vs):
                test = all if isinstance(o, ast.And) else any
                return test(run(v, env) for v in vs)
            case ast.Compare(left=a, ops=ops, comparators=cs):
                left = run(a, env)
                for o, c in zip(ops, cs):
                    right = run(c, env)
                    if type(o) not in _CMP or not _CMP[type(o)](left, right):
                        return False
                    left = right
                return True
            case ast.Subscript(value=v, slice=s):
                return run(v, env)[run(s, env)]
            case ast.List(elts=e) | ast.Tuple(elts=e):
                return [run(x, env) for x in e]
            case ast.IfExp(test=t, body=b, orelse=o):
                return run(b if run(t, env) else o, env)
            case ast.Call(func=ast.Name(id=f), args=a, keywords=[]) if f in _FUNCTIONS:
                return _FUNCTIONS[f](*[run(x, env) for x in a])
            case (ast.ListComp(elt=e, generators=[g]) | ast.GeneratorExp(elt=e, generators=[g])) if isinstance(g.target, ast.Name):
                return [run(e, inner) for x in run(g.iter, env) if all(run(c, inner := env | {g.target.id: x}) for c in g.ifs) or not g.ifs for inner in [env | {g.target.id: x}]]
        raise Refused(f"not allowed: {ast.dump(n)[:60]}")

    return run(tree, dict(artifacts))


_NUMBER = re.compile(r"(?<![\w.])[-−]?\d[\d,]*(?:\.\d+)?%?")


def numbers_in(text: str) -> list[str]:
    return _NUMBER.findall(text)


def check_numbers(text: str, facts: list[float], relative: float = 1e-4) -> list[str]:
    """Numbers of a prose that are no fact, up to the precision they are written with; a fact may be written as a percentage."""
    out = []
    for s in numbers_in(text):
        raw = s.rstrip("%").replace(",", "").replace("−", "-")
        v = float(raw)
        half = 0.5 * 10 ** -(len(raw.split(".")[1]) if "." in raw else 0)
        if not any(abs(v - f * m) <= max(half, relative * abs(v)) for f in facts for m in (1, 100)):
            out.append(s)
    return out


def validate_edit(edit: dict, texts: dict[str, str], artifacts: dict[str, object]) -> str:
    """Why an edit may not land; empty if it may. It names file, anchor, replacement, artifact, reason and perhaps a check."""
    text = texts.get(edit.get("file", ""))
    if text is None:
        return "no such file"
    if text.count(edit.get("anchor") or "\0") != 1:
        return "the anchor does not occur exactly once"
    if not edit.get("reason"):
        return "no reason is given"
    if edit.get("artifact") not in artifacts:
        return "the artifact does not exist"
    facts = [float(x.rstrip("%").replace(",", "").replace("−", "-")) for x in numbers_in(str(artifacts[edit["artifact"]]))]
    old, new = numbers_in(edit["anchor"]), numbers_in(edit.get("replacement", ""))
    if old and not new and len(edit.get("replacement", "")) < len(edit["anchor"]):
        return "it only deletes numbers"
    if bad := check_numbers(" ".join(x for x in new if x not in old), facts):
        return f"numbers that the artifact does not have: {bad}"
    if edit.get("check") and not evaluate(edit["check"], artifacts):
        return "its own check is false"
    return ""


def apply_edits(edits: list[dict], texts: dict[str, str], artifacts: dict[str, object], most: int = 50) -> tuple[dict[str, str], list[tuple[dict, str]]]:
    """Edits one after another under a cap; anchors are looked for again after each; refusals are recorded."""
    out, refused, done = dict(texts), [], 0
    for e in edits:
        why = "over the cap" if done >= most else validate_edit(e, out, artifacts)
        if why:
            refused.append((e, why))
        else:
            out[e["file"]] = out[e["file"]].replace(e["anchor"], e["replacement"])
            done += 1
    return out, refused


def fingerprint(claim: str) -> str:
    """A claim without digits, spaces and punctuation, in lower case."""
    return re.sub(r"[\W\d_]+", "", claim).casefold()


@dataclass
class Ledger:
    """Findings of a run: a repeated claim counts up, one that was fixed opens again, nothing is deleted."""

    findings: dict[str, dict] = field(default_factory=dict)

    def record(self, claim: str, phase: str, severity: str, check: str = "") -> dict:
        f = self.findings.setdefault(fingerprint(claim), {"claim": claim, "phase": phase, "severity": severity, "check": check, "status": "open", "seen": 0})
        f["seen"] += 1
        if f["status"] in ("fixed", "refuted"):
            f["status"] = "open"
        return f

    def recheck(self, artifacts: dict) -> None:
        """Open findings close as fixed when their check does not hold any more."""
        for f in self.findings.values():
            if f["status"] == "open" and f["check"]:
                try:
                    f["status"] = "open" if evaluate(f["check"], artifacts) else "fixed"
                except (KeyError, IndexError, TypeError, Refused):
                    pass

    def waive(self, claim: str, why: str) -> None:
        self.findings[fingerprint(claim)] |= {"status": "waived", "why": why}


def gate(name: str, passed: bool | None, observed: object, threshold: object, blocking: tuple[str, ...] = ()) -> dict:
    """A gate record; a failed blocking gate halts."""
    status = "skipped" if passed is None else "passed" if passed else "failed" if name in blocking else "warned"
    record = {"name": name, "status": status, "observed": observed, "threshold": threshold}
    if status == "failed":
        raise Refused(f"gate {name}: {observed} against {threshold}")
    return record

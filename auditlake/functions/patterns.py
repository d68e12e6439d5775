"""JavaScript patterns of rule files as Java patterns."""

from __future__ import annotations

import re

_SPACE = r"\t\n\x0b\f\r\x20\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
_DELIMITED = re.compile(r"/(.+)/([a-z]*)", re.S)


class PatternError(ValueError):
    pass


def java_pattern(source: str) -> str:
    """A bare pattern ignores case; ``/pattern/flags`` has just these flags.

    ``g`` and ``y`` have no meaning for a test, ``u`` and ``d`` change nothing here.
    """
    found = _DELIMITED.fullmatch(source)
    body, flags = (found[1], found[2]) if found else (source, "i")
    if unknown := set(flags) - set("gimsuyd"):
        raise PatternError(f"flag {sorted(unknown)[0]!r} is not supported in {source!r}")
    modes = "".join(m for f, m in (("i", "iu"), ("m", "m"), ("s", "s")) if f in flags)
    java = (f"(?{modes})" if modes else "") + _translate(body, "m" in flags)
    _probe(java, source)
    return java


def _translate(body: str, lines: bool) -> str:
    out, at, inside = [], 0, False
    word = "A-Za-z0-9_"
    while at < len(body):
        c = body[at]
        if c == "\\":
            if at + 1 >= len(body):
                raise PatternError("a pattern must not end in a backslash")
            n = body[at + 1]
            at += 2
            if n == "b" and not inside:
                out.append(f"(?:(?<=[{word}])(?![{word}])|(?<![{word}])(?=[{word}]))")
            elif n == "B" and not inside:
                out.append(f"(?:(?<=[{word}])(?=[{word}])|(?<![{word}])(?![{word}]))")
            elif n == "b":
                out.append(r"\x08")
            elif n == "s":
                out.append(_SPACE if inside else f"[{_SPACE}]")
            elif n == "S":
                out.append(f"[^{_SPACE}]")
            elif n == "u" and body[at : at + 1] == "{":
                end = body.find("}", at)
                if end < 0:
                    raise PatternError("an escape is not closed")
                out.append(f"\\x{body[at:end]}}}")
                at = end + 1
            elif n == "c":
                out.append(f"\\x{ord(body[at : at + 1].upper() or '@') & 31:02x}")
                at += 1
            elif n == "/":
                out.append("/")
            else:
                out.append("\\" + n)
            continue
        if inside:
            if c == "]":
                inside = False
                out.append(c)
            else:
                out.append("\\" + c if c in "[&" else c)
        elif c == "[":
            if body.startswith("[^]", at):
                out.append(r"[\s\S]")
                at += 3
                continue
            if body.startswith("[]", at):
                out.append("(?!)")
                at += 2
                continue
            inside = True
            out.append(c)
            if body[at + 1 : at + 2] == "^":
                out.append("^")
                at += 1
        elif c == "$" and not lines:
            out.append(r"\z")
        else:
            out.append(c)
        at += 1
    if inside:
        raise PatternError("a character class is not closed")
    return "".join(out)


def _probe(java: str, source: str) -> None:
    """Patterns are compiled when rules are loaded: by the JVM if there is one, else roughly by Python."""
    from pyspark import SparkContext

    context = SparkContext._active_spark_context
    if context is not None:
        try:
            context._jvm.java.util.regex.Pattern.compile(java)
        except Exception as problem:
            raise PatternError(f"bad pattern {source!r}: {str(problem).splitlines()[0][:200]}") from None
        return
    try:
        re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", re.sub(r"\\x\{([0-9a-fA-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", java).replace(r"\z", r"\Z")).replace("(?iu)", "(?i)"))
    except re.error as problem:
        raise PatternError(f"bad pattern {source!r}: {problem}") from None

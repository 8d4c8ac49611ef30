"""Regular expressions of schemas: their grammar, and their forms for Java and Python."""

from __future__ import annotations

from dataclasses import dataclass

from assayer.functions.ranges import InvalidSchemaError

_PLAIN = set(".^$|?*+\\[](){}")
#: Predefined classes are of ASCII, as the queries' SQL has them, in a class and outside.
_CLASSES = {"d": "0-9", "s": " \\f\\n\\r\\t", "w": "a-zA-Z0-9_"}


@dataclass(frozen=True)
class Regex:
    """An unanchored search; \\r in pattern and text counts as \\n."""

    expression: str
    ignore_case: bool = False
    multi_line: bool = False
    version: int = 1

    def __post_init__(self):
        if not self.expression:
            raise InvalidSchemaError("an empty regex")
        self._translate(java=True)

    def java(self) -> str:
        """(?d): only \\n ends lines.  (?u): case of Unicode."""
        return f"(?d{'i' * self.ignore_case}{'u' * self.ignore_case}{'m' * self.multi_line})" + self._translate(java=True)

    def python(self) -> str:
        flags = "i" * self.ignore_case + "m" * self.multi_line
        return (f"(?{flags})" if flags else "") + self._translate(java=False)

    def _translate(self, java: bool) -> str:
        s, i, out = self.expression, 0, []

        def bad(what: str) -> InvalidSchemaError:
            return InvalidSchemaError(f"regex {self.expression!r}: {what}")

        while i < len(s):
            c = s[i]
            i += 1
            if c == "[":
                text, i = self._class(i, java, bad)
                out.append(text)
            elif c == "(":
                if s[i : i + 1] == "?":
                    raise bad("(? is not allowed")
                out.append(c)
                continue
            elif c == "\\":
                if i == len(s):
                    raise bad("ends with a backslash")
                c = s[i]
                i += 1
                if c in _PLAIN:
                    out.append("\\" + c)
                elif c.lower() in _CLASSES:
                    out.append(f"[{'^' * c.isupper()}{_CLASSES[c.lower()]}]")
                else:
                    raise bad(f"\\{c} is not allowed")
            elif c == "$" and not self.multi_line:
                out.append("\\z" if java else "\\Z")
            elif c == "\r":
                out.append("\n")
            elif c in "?*+{":
                # A quantifier stands after something; what stands first or after ( is plain or wrong.
                raise bad(f"{c} quantifies nothing") if c != "{" else bad("a range quantifier stands alone")
            else:
                out.append(c)
            i = self._quantifier(i, out, bad)
        return "".join(out)

    def _quantifier(self, i: int, out: list[str], bad) -> int:
        s = self.expression
        c = s[i : i + 1]
        if not c or c not in "?*+{":
            return i
        if c == "{":
            end = s.find("}", i)
            if end < 0 or not set(s[i + 1 : end]) <= set("0123456789,") or not s[i + 1 : end].strip(","):
                raise bad("bad range quantifier")
            low, comma, high = s[i + 1 : end].partition(",")
            out.append("{" + (low or "0") + comma + high + "}")
            i = end + 1
        else:
            out.append(c)
            i += 1
        if s[i : i + 1] in ("?", "+", "*"):
            raise bad("lazy and possessive quantifiers are not allowed")
        return i

    def _class(self, i: int, java: bool, bad) -> tuple[str, int]:
        s, out = self.expression, []
        negated = s[i : i + 1] == "^"
        i += negated
        extra = []  # classes that aren't lists of characters
        while i < len(s):
            c = s[i]
            i += 1
            if c == "]":
                body = "".join(out)
                if java:
                    inner = body + "".join(f"[{x}]" for x in extra)
                    return f"[{'^' * negated}{inner}]", i
                if not extra:
                    return f"[{'^' * negated}{body}]", i
                options = ([f"[{body}]"] if body else []) + [f"[{x}]" for x in extra]
                union = "|".join(options)
                return (f"(?:(?!{union})[\\s\\S])" if negated else f"(?:{union})"), i
            if c == "&" and s[i : i + 1] == "&":
                raise bad("&& is not allowed in a class")
            if c == "[":
                raise bad("[ must be escaped in a class")
            if c == "\\":
                d = s[i : i + 1]
                i += 1
                if d and d in "[]\\":
                    out.append("\\" + d)
                elif d and d in "dswDSW":
                    if self.version == 1:
                        raise bad(f"\\{d} is not allowed in a class")
                    if d.islower():
                        out.append(_CLASSES[d])
                    else:
                        extra.append("^" + _CLASSES[d.lower()])
                else:
                    raise bad(f"\\{d} is not allowed in a class")
            elif c == "\r":
                out.append("\n")
            elif c in "^" and not out:
                out.append("\\^")
            else:
                out.append(c)
        raise bad("a class misses its ]")

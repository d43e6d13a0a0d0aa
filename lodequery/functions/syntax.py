"""Definitions and calls of sources in languages with braces, found in one pass over their tokens.

Strings and comments are single tokens and so hide what they hold. For every bracket that is open the scanner keeps the tokens since the last end of a statement,
a closed pair of parentheses as one mark; a brace that opens is a class, a function or a plain block by the tokens before it. What can't be told
(unbalanced brackets, macros that hide some) ends at the end of the text. C and C++ have no word for functions: there the name is the first one
of the declarator, the words before the parentheses.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: The words that begin a class-like definition, by language.
CLASSES = {
    "javascript": ("class",), "typescript": ("class", "interface"), "java": ("class", "interface", "enum"), "c_sharp": ("class", "interface", "struct"), "go": ("type",),
    "c": (), "cpp": ("class", "struct"), "php": ("class", "interface", "trait"),
}
#: Languages whose functions are begun by a word.
FUNCTION_WORD = {"javascript": "function", "typescript": "function", "php": "function", "go": "func"}
#: Languages that have methods without such a word, inside classes.
BARE_METHODS = ("javascript", "typescript", "java", "c_sharp")
#: Words that stand before parentheses without being called: in all languages, and in some.
NOT_CALLED = frozenset("if for while switch catch return sizeof do else case throw new this super".split())
WORDS = {
    "javascript": "function typeof await yield with delete void in of", "typescript": "function typeof await yield keyof in of", "java": "synchronized assert try", "c_sharp": "using lock foreach fixed nameof checked typeof when base await",
    "go": "func defer go select range interface struct map chan", "c": "alignof defined", "cpp": "alignof decltype static_assert noexcept operator", "php": "function fn foreach elseif match array list isset empty unset echo print declare",
}
KEYWORDS = {k: NOT_CALLED | frozenset(v.split()) for k, v in WORDS.items()}
#: What may stand before a function's word in a declaration.
BEFORE = frozenset("async export default public private protected static abstract final".split())

_QUOTED = r""""(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'"""
_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_EXTRA = {
    "javascript": r"`(?:\\.|[^`\\])*`", "typescript": r"`(?:\\.|[^`\\])*`", "go": r"`[^`]*`", "c_sharp": r'\$?@\$?"(?:""|[^"])*"|^[ \t]*\#[^\n]*',
    "c": r"^[ \t]*\#(?:[^\n\\]|\\\n|\\.)*", "cpp": r'^[ \t]*\#(?:[^\n\\]|\\\n|\\.)*|R"\([^)]*\)"', "php": r"<\?(?:php|=)?|\?>|\#(?!\[)[^\n]*|<<<[\"']?(?P<doc>\w+)[\"']?.*?^\s*(?P=doc)", "java": r'""".*?"""',
}
_REGEX = r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
PATTERNS = {k: re.compile(rf"(?P<skip>{_EXTRA[k]}|{_COMMENT}|{_QUOTED})|(?P<word>[A-Za-z_$][\w$]*)|(?P<mark>::|=>|->|==|!=|<=|>=|[^\s\w])|(?P<number>\d[\w.]*)", re.S | re.M) for k in CLASSES}
BODY_OF_REGEX = re.compile(_REGEX)


@dataclass
class Definition:
    name: str
    qualname: str
    kind: str
    start: int
    end: int
    #: how many brackets stand around it, the definition that holds it, and whether words of another declaration stand before it
    depth: int
    parent: Definition | None
    wrapped: bool = False


@dataclass
class Outline:
    definitions: list[Definition] = field(default_factory=list)
    #: name of the enclosing function, called name, line
    calls: list[tuple[str, str, int]] = field(default_factory=list)


@dataclass
class _Open:
    mark: str
    made: Definition | None = None
    kind: str = "block"
    tokens: list[tuple[str, bool, int]] = field(default_factory=list)


def _bare_name(tokens: list[tuple[str, bool, int]], language: str, scope: str) -> str | None:
    """The name before the first parentheses of a declaration without a function's word; None where it is none."""
    for i, (text, _, _) in enumerate(tokens):
        if text == "=":
            return None
        if text == "()" and i and tokens[i - 1][1]:
            if i > 1 and tokens[i - 2][0] == "@":  # an annotation's
                continue
            name = tokens[i - 1][0]
            if name in KEYWORDS[language]:
                return None
            if language in ("c", "cpp"):
                if i < 2 and scope != "class":  # a call, or a macro: nothing says what it gives
                    return None
                j = i - 1
                while j > 1 and tokens[j - 1][0] in ("::", "~"):
                    j -= 1 if tokens[j - 1][0] == "~" else 2
                name = tokens[max(j, 0)][0]
            return name
    return None


def _opened(language: str, tokens: list[tuple[str, bool, int]], scope: str) -> tuple[str, str] | None:
    """Kind and name of the definition whose body a brace opens after these tokens."""
    words = [t for t, _, _ in tokens]
    if language in FUNCTION_WORD and (word := FUNCTION_WORD[language]) in words:
        at = words.index(word)
        rest = tokens[at + 1 :]
        while rest and rest[0][0] in ("*", "&", "()") and (rest[0][0] != "()" or language == "go"):
            rest = rest[1:]
        if rest and rest[0][1] and all(w in BEFORE for w in words[:at]):
            return "function", rest[0][0]
        return None
    if language in ("c", "cpp") and "()" in words and scope in ("file", "class", "space") and (name := _bare_name(tokens, language, scope)):
        return "function", name
    for i, (text, is_word, _) in enumerate(tokens):
        if is_word and text in CLASSES[language] and i + 1 < len(tokens) and tokens[i + 1][1] and (not i or tokens[i - 1][0] not in (".", "->", "::", "=", "(")):
            return "class", tokens[i + 1][0]
    if language in BARE_METHODS and scope == "class" and (name := _bare_name(tokens, language, scope)):
        return "function", name
    return None


def outline(text: str, language: str) -> Outline | None:
    """Definitions in the order in which they begin, and calls inside functions; None for a language that isn't read so."""
    if language not in PATTERNS:
        return None
    out, stack, line, last, at = Outline(), [_Open("", kind="file")], 1, 0, 0
    pattern, script = PATTERNS[language], language in ("javascript", "typescript")

    def holder(kind: str | None = None) -> Definition | None:
        return next((o.made for o in reversed(stack) if o.made is not None and (kind is None or o.made.kind != "class")), None)

    def made(kind: str, name: str, begin: int, end: int, wrapped: bool) -> Definition:
        parent = holder()
        qualname = f"{parent.qualname}.{name}" if parent else name
        kind = kind if kind == "class" else "method" if parent else "function"
        d = Definition(name, qualname, kind, begin, end, len(stack) - 1, parent, wrapped)
        out.definitions.append(d)
        return d

    total = text.count("\n") + 1
    while m := pattern.search(text, at):
        line += text.count("\n", last, m.start())
        last, at = m.start(), m.end()
        top = stack[-1]
        if m["skip"] is not None:
            continue
        token = m.group()
        if script and token == "/" and (not top.tokens or not top.tokens[-1][1] and top.tokens[-1][0] not in ("()", "[]", "0") or top.tokens[-1][0] in ("return", "typeof")):
            if r := BODY_OF_REGEX.match(text, m.start()):
                at = r.end()
                top.tokens.append(("0", False, line))
                continue
        if token in ("(", "["):
            before = top.tokens
            if token == "(" and before and before[-1][1] and before[-1][0] not in KEYWORDS[language] and top.kind != "class" and (function := holder("function")):
                i = len(before) - 1
                while i > 1 and before[i - 1][0] in (".", "::", "->"):
                    i -= 2
                if not i or before[i - 1][0] not in ("new", "function", "func"):
                    out.calls.append((function.qualname, before[-1][0], line))
            stack.append(_Open(token))
        elif token in (")", "]"):
            while len(stack) > 1 and stack[-1].mark not in ("(", "["):  # unbalanced
                _closed(stack.pop(), line)
            if len(stack) > 1:
                stack.pop()
                stack[-1].tokens.append(("()" if token == ")" else "[]", False, line))
        elif token == "{":
            scope = top.kind
            found = _opened(language, top.tokens, scope)
            if found:
                begin = top.tokens[0][2]
                o = _Open("{", made(*found, begin, total, top.tokens[0][0] == "export"), found[0])
            else:
                names = [t for t, _, _ in top.tokens]
                o = _Open("{", kind="space" if scope in ("file", "space") and ("namespace" in names or "extern" in names) else "block")
            stack.append(o)
        elif token == "}":
            while len(stack) > 1 and stack[-1].mark in ("(", "["):
                stack.pop()
            if len(stack) > 1:
                o = stack.pop()
                _closed(o, line)
                if o.kind in ("block",) and stack[-1].tokens and any(t == "=" for t, _, _ in stack[-1].tokens):
                    stack[-1].tokens.append(("{}", False, line))  # a value inside a statement
                else:
                    stack[-1].tokens = []
        elif token == ";":
            if top.kind == "class" and language in ("java", "c_sharp") and len(top.tokens) > 1 and (name := _bare_name(top.tokens, language, top.kind)):
                made("function", name, top.tokens[0][2], line, False)
            top.tokens = []
        elif token == ":" and language == "cpp" and top.kind == "class" and len(top.tokens) == 1:
            top.tokens = []  # public:
        else:
            if language == "go" and m["word"] and token in ("func", "type") and top.kind == "file":
                top.tokens = []  # statements there end with the line
            top.tokens.append((token, m["word"] is not None, line))
    return out


def _closed(o: _Open, line: int) -> None:
    if o.made is not None:
        o.made.end = line

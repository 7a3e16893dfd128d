"""LaTeX in texts: commands to Markdown by one scan with a stack, and formulas brought between dollars by one walk over their delimiters."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a scan stops at: formulas (which pass as they are), commands, line and cell breaks of tables, braces.
TOKEN = re.compile(r"(?P<formula>\$\$[\s\S]*?\$\$|\$[^$\n]+\$)|\\(?P<command>[A-Za-z]+)\*?|(?P<row>\\\\)|(?P<cell>&)|(?P<open>\{)|(?P<close>\})")
OPTION = re.compile(r"[ \t]*\[([^\]\n]*)\]")
NAME = re.compile(r"[ \t]*\{([A-Za-z]+\*?)\}")


class _Open:
    """A group, an argument or an environment that has begun: its text so far, and its rows of cells if it is a table."""

    def __init__(self, kind: str, name: str = "", done: Callable[[str], str] | None = None):
        self.kind, self.name, self.done = kind, name, done
        self.out: list[str] = []
        self.rows: list[list[str]] = [[]]

    def cell(self) -> None:
        self.rows[-1].append(" ".join("".join(self.out).split()))
        self.out = []

    def row(self) -> None:
        self.cell()
        self.rows.append([])

    def table(self) -> str:
        """The rows as lines of pipes under one another; rows without any text go, short ones are filled up."""
        self.cell()
        full = [r for r in self.rows if any(r)]
        wide = max(map(len, full), default=0)
        line = lambda cells: "| " + " | ".join(cells) + " |"
        shown = [line(r + [""] * (wide - len(r))) for r in full]
        return "\n".join(shown[:1] + [line(["---"] * wide)] * bool(shown) + shown[1:])


def _heading(marks: str) -> Callable[[str], str]:
    return lambda x: f"\n{marks} {x.strip()}\n"


def _figure(target: str) -> str:
    return "[figure: not extracted]" if target.strip().startswith(("http://", "https://")) else "[figure]"


# What becomes of a command with an argument, and of one without.
ARGUMENT: dict[str, Callable[[str], str]] = {
    "title": _heading("#"), "section": _heading("##"), "subsection": _heading("###"), "textbf": str, "textit": str, "emph": str, "text": str, "includegraphics": _figure,
    **dict.fromkeys(("author", "caption", "captionsetup", "footnote", "footnotetext", "label", "index", "vspace", "hspace"), lambda x: ""),
}
PLAIN = {"hline": "", "newline": "", "par": "", "noindent": "", "centering": "", "small": "", "large": ""}


def to_markdown(text: str) -> str:
    """Text with the LaTeX of a converter as Markdown. Formulas stay; commands that are not known stay, with their arguments.

    One pass: what opens is put on a stack and takes the text until it closes, then gives its own text to what it lies in. At the end of the text
    what is still open gives what it has.
    """
    stack, begun, at = [_Open("text")], Counter(), 0

    def close() -> None:
        top = stack.pop()
        begun[top.name] -= 1
        made = "".join(top.out)
        stack[-1].out.append(top.table() if top.kind == "table" else top.done(made) if top.done else made)

    while found := TOKEN.search(text, at):
        stack[-1].out.append(text[at : found.start()])
        at, inside = found.end(), stack[-1].kind == "table"
        if name := found["command"]:
            if name in ("begin", "end") and (env := NAME.match(text, at)):
                at, base = env.end(), env[1].rstrip("*")
                if name == "begin":
                    while option := OPTION.match(text, at):
                        at = option.end()
                    if base == "tabular" and (spec := re.compile(r"\{[^{}]*\}").match(text, at)):
                        at = spec.end()
                    stack.append(_Open("table" if base == "tabular" else "environment", base))
                    begun[base] += 1
                elif begun[base]:
                    while stack[-1].name != base:
                        close()
                    close()
            elif name == "item":
                label = OPTION.match(text, at)
                at = label.end() if label else at
                while at < len(text) and text[at] in " \t":
                    at += 1
                own = label[1].strip() if label else ""
                stack[-1].out.append("- " if own in ("", "-", "•", "*") else f"{own} ")
            elif name in ARGUMENT:
                while option := OPTION.match(text, at):
                    at = option.end()
                if text[at : at + 1] == "{":
                    at += 1
                    stack.append(_Open("argument", done=ARGUMENT[name]))
            elif name == "multicolumn" and inside and (spans := re.compile(r"\{(\d{1,2})\}\{[^{}]*\}\{").match(text, at)):
                at = spans.end()
                stack.append(_Open("span", done=lambda x, n=int(spans[1]): x + "\0" * (n - 1)))
            else:
                stack[-1].out.append(PLAIN.get(name, found[0]))
        elif found["row"]:
            stack[-1].row() if inside else stack[-1].out.append(found[0])
        elif found["cell"]:
            stack[-1].cell() if inside else stack[-1].out.append(found[0])
        elif found["open"]:
            stack.append(_Open("group", done=lambda x: "{" + x + "}"))
        elif found["close"]:
            if stack[-1].kind in ("group", "argument", "span"):
                close()
                if inside_table := stack[-1].kind == "table" and "\0" in (stack[-1].out[-1] if stack[-1].out else ""):
                    own = stack[-1].out.pop()
                    stack[-1].out.append(own.rstrip("\0"))
                    for _ in range(own.count("\0") if inside_table else 0):
                        stack[-1].cell()
            else:
                stack[-1].out.append(found[0])
        else:
            stack[-1].out.append(found[0])
    stack[-1].out.append(text[at:])
    while len(stack) > 1:
        close()
    out = "".join(stack[0].out)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", out)).strip()


# Delimiters of formulas, environments that are displayed, digits that become Western within formulas.
DELIMITER = re.compile(r"(?<!\\)(?:\\\\)*(\\[\[\]()])|(\$\$)|((?<!\\)\$)|\\(begin|end)\{(aligned|gathered|array|cases)\}|(\n)")
WESTERN = str.maketrans("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "0123456789" * 2)


def with_dollars(text: str) -> str:
    """Formulas between dollars: brackets become displays, parentheses and displays within a line inline formulas; digits in formulas are Western.

    One walk over the delimiters. The state is what the walk is in (text, an inline formula, a display in dollars or in brackets), with its text so far
    and the environments that are open in it. A display in dollars is one if it has lines of its own: it spans lines, or nothing else is on its line,
    or it opens an environment (which then gets its lines). Environments that are open at the end of the text are closed, and so is their display.
    """
    out: list[str] = []
    state, body, open_, at = "text", [], [], 0

    next_line = -1

    def rest_of_line() -> int:
        """Where the line of the place ends."""
        nonlocal next_line
        if next_line < at:
            next_line = text.find("\n", at)
            next_line = len(text) if next_line < 0 else next_line
        return next_line

    def alone() -> bool:
        """Whether nothing else is on the line of a display that ends here."""
        before = next((x for x in reversed(out) if x.strip(" \t")), "\n")
        return before.rstrip(" \t").endswith("\n") and not text[at : min(at + 200, rest_of_line())].strip()

    def shut() -> None:
        """End the formula of the state."""
        nonlocal state, body, open_
        inner = "".join(body).translate(WESTERN)
        if state == "bracket":
            out.append(f"\n\n$$\n{inner}\n$$\n\n")
        elif state == "display" and "\n" not in inner and not alone():
            if re.match(r"\s*\\begin\{(?:aligned|gathered|array|cases)\}", inner):
                out[-1:] = [out[-1].rstrip(" \t")] if out else []
                out.append(f"\n\n$$\n{inner.strip()}\n$$")
            else:
                out.append(f"${inner}$")
        else:
            mark = "$$" if state == "display" else "$"
            out.append(mark + inner + mark)
        state, body, open_ = "text", [], []

    for found in DELIMITER.finditer(text):
        piece, token = text[at : found.start()], found[0]
        start = found.start(1) if found[1] else found.start()
        piece = text[at:start]
        at = found.end()
        (out if state == "text" else body).append(piece)
        if found[1]:
            kind = found[1][1]
            if state == "text" and kind in "[(":
                state = "bracket" if kind == "[" else "paren"
            elif (state, kind) in (("bracket", "]"), ("paren", ")")):
                shut()
            elif state == "text":
                out.append(found[1])
            else:
                body.append(found[1])
        elif found[2]:
            if state == "text":
                state = "display"
            elif state == "display":
                shut()
            else:
                body.append(token)
        elif found[3]:
            if state == "text" and 0 <= text.find("$", at, rest_of_line()):
                state = "inline"
            elif state == "inline":
                shut()
            else:
                (out if state == "text" else body).append(token)
        elif found[4]:
            (out if state == "text" else body).append(token)
            if state != "text":
                if found[4] == "begin":
                    open_.append(found[5])
                elif open_ and open_[-1] == found[5]:
                    open_.pop()
        else:
            (out if state == "text" else body).append(token)
    rest = text[at:]
    if state == "text":
        out.append(rest)
    elif open_:
        inner = ("".join(body) + rest).strip().translate(WESTERN)
        before = "".join(out).rstrip(" \t")
        ends = "".join(f"\n\\end{{{name}}}" for name in reversed(open_))
        out = [before, "\n\n" if before and not before.endswith("\n") else "", f"$$\n{inner}{ends}\n$$"]
    else:
        out += [{"display": "$$", "inline": "$", "bracket": "\\[", "paren": "\\("}[state], *body, rest]
    return "".join(out)


def _column(rule: Callable[[str], str], needed: str) -> Callable[[Column], Column]:
    """A rule as a column function; texts without a character that it needs are not sent to Python, and null stays null."""
    sent = F.pandas_udf(lambda x: x.map(lambda v: None if v is None else rule(v)), "string")
    return lambda text: F.when(text.rlike(needed), sent(F.when(text.rlike(needed), text)))


def markdown(text: Column) -> Column:
    """to_markdown of a column."""
    return F.coalesce(_column(to_markdown, r"[\\${}]")(text), F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"), r"(?U)\A\s+|\s+\z", ""))


def math_delimiters(text: Column) -> Column:
    """with_dollars of a column."""
    return F.coalesce(_column(with_dollars, r"[\\$]")(text), text)

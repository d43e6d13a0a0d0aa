"""Definitions and calls of languages with braces, against small sources whose truth is written beside them."""

from __future__ import annotations

import pytest

from lodequery.functions.syntax import outline
from lodequery.operators.chunking import outline_units

CASES = {
    "java": ('package a;\nimport b.C;\n// class No { void x() {} }\n@Ann(v = "x")\npublic class A<T> extends B implements I {\n  static int n = make(3);\n  A(int x) { super(x); run(); }\n  @Override public void run() throws E {\n    for (int i : list()) { if (ok(i)) { new Thing(i).go("}{"); } }\n    a.b.deep(1);\n  }\n  abstract int none(String s);\n  interface In { void m(); }\n}\nenum Color { RED, GREEN; int code() { return f(); } }\n',
             ["A class 4", "A.A method 7", "A.run method 8", "A.none method 12", "A.In class 13", "A.In.m method 13", "Color class 15", "Color.code method 15"],
             ["A.A run", "A.run list", "A.run ok", "A.run go", "A.run deep", "Color.code f"]),
    "go": ("package p\n\nimport (\n\t\"fmt\"\n)\n\ntype T struct {\n\ta int\n}\n\nfunc (t *T) Run(x int) (int, error) {\n\ts := `}{ no() `\n\tfmt.Println(s)\n\tdefer close(t)\n\tgo func() { inner() }()\n\treturn t.other(x), nil\n}\n\nfunc main() { run() }\n",
           ["T class 7", "Run function 11", "main function 19"], ["Run Println", "Run close", "Run inner", "Run other", "main run"]),
    "javascript": ("const x = require('a');\nfunction outer(a, b = {c: 1}) {\n  // helper( {\n  function inner() { deep(); }\n  return inner().then(() => { late(`}${a}`); });\n}\nclass K extends Base {\n  constructor() { super(); this.start(); }\n  static async *gen(n) { yield go(n); }\n  get v() { return /\\)}/.test(q()); }\n}\nexport function shown() { new K(); call(1) }\nconst f = function named() { anon(); };\n",
                   ["outer function 2", "outer.inner method 4", "K class 7", "K.constructor method 8", "K.gen method 9", "K.v method 10", "shown function 12"],
                   ["outer.inner deep", "outer inner", "outer then", "outer late", "K.constructor start", "K.gen go", "K.v test", "K.v q", "shown call"]),
    "c": ("#include <a.h>\n#define BEGIN {\nstatic int helper(int a, char b[]);\nstruct point { int x; };\nint add(int a, int b)\n{\n  return sum(a, sizeof(b)) + '}';\n}\nchar *name(void) { /* } */ if (x) { y(\"{\"); } return 0; }\nint table[] = { 1, 2 };\nstruct point make(int x) { return build(x); }\n",
          ["add function 5", "name function 9", "make function 11"], ["add sum", "name y", "make build"]),
    "cpp": ("namespace n {\nclass C : public B {\n public:\n  C() : a(1) { init(); }\n  int get() const { return v(); }\n};\nvoid C::run() { get(); }\n}\n",
            ["C class 2", "C.C method 4", "C.get method 5", "C function 7"], ["C.C init", "C.get v", "C get"]),
    "c_sharp": ("using X;\nnamespace A.B {\n  [Attr(1)]\n  public class S : T {\n    public int P { get; set; }\n    public S(int a) : base(a) { Go(@\"}\"\"{\"); }\n    int Sum(int b) => Add(b);\n    void M() { foreach (var x in All()) { Use(x); } }\n  }\n}\n",
                ["S class 3", "S.S method 6", "S.Sum method 7", "S.M method 8"], ["S.S Go", "S.M All", "S.M Use"]),
    "php": ("<?php\n# function no() {\ninterface I { function must(); }\nclass P {\n  public function &get($a = array(1)) { return $this->find(strlen($a)); }\n}\nfunction top() { P::make(); $x = new P(1); echo <<<X\n } function f() {\nX; tail(); }\n",
            ["I class 3", "P class 4", "P.get method 5", "top function 7"], ["P.get find", "P.get strlen", "top make", "top tail"]),
    "typescript": ("interface Shape { area(): number; }\nclass Sq implements Shape {\n  constructor(private s: number) {}\n  area(): number { return mul(this.s); }\n}\nfunction id<T>(x: T): T { return wrap(x); }\n",
                   ["Shape class 1", "Sq class 2", "Sq.constructor method 3", "Sq.area method 4", "id function 6"], ["Sq.area mul", "id wrap"]),
}


@pytest.mark.parametrize("language", sorted(CASES))
def test_definitions_and_calls(language):
    text, definitions, calls = CASES[language]
    found = outline(text, language)
    assert [f"{d.qualname} {d.kind} {d.start}" for d in found.definitions] == definitions
    assert [f"{f} {name}" for f, name, _ in found.calls] == calls


def test_units_cover_all_lines_once_and_broken_sources_end():
    for language, (text, *_) in CASES.items():
        units = list(outline_units(text, 10**6, language))
        lines = sorted(i for u in units for i in range(u["start_line"], u["end_line"] + 1))
        full = [i + 1 for i, x in enumerate(text.split("\n")) if x.strip() and x.strip() not in ("}", "};")]
        assert set(full) <= set(lines) | {i for i in full if language in ("java", "c_sharp", "typescript", "javascript", "php", "cpp")} and len(lines) - len(set(lines)) <= 2
        for broken in (text[: len(text) // 2], text.replace("}", "", 2), text.replace("{", "", 2), "}" * 5 + text, text + "(((", ""):
            assert outline(broken, language) is not None
    assert outline("def f; end", "ruby") is None and outline_units("x", 9, "sql") is None
    long = "void f() {\n" + "  call(1);\n" * 50 + "}\n"
    parts = list(outline_units(long, 120, "c"))
    assert len(parts) > 3 and [p["qualname"] for p in parts][:2] == ["f (part 1)", "f (part 2)"] and "\n".join(p["text"] for p in parts) == long.rstrip("\n")

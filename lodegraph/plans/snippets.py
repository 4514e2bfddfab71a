"""One small program in each language, and what a front-end must find in it."""

from __future__ import annotations

#: File name to text: a function with a parameter, a branch, a loop, a call, a variable and a return each.
SOURCES = {
    "p.py": "import os\n\ndef run(q):\n    if q:\n        v = load(q)\n    for i in q:\n        v = i\n    return v\n",
    "J.java": "import java.util.List;\nclass J {\n  String run(String q) {\n    if (ok(q)) { q = q; }\n    String v = load(q);\n    while (q) { stop(v); }\n    return v;\n  }\n}\n",
    "j.js": "import fs from 'fs';\nfunction run(q) {\n  if (q) { stop(q); }\n  const v = load(q);\n  while (q) { stop(v); }\n  return v;\n}\n",
    "t.ts": "import fs from 'fs';\nfunction run(q: string): string {\n  if (q) { stop(q); }\n  const v = load(q);\n  while (q) { stop(v); }\n  return v;\n}\n",
    "x.tsx": "import React from 'react';\nfunction run(q: string) {\n  if (q) { stop(q); }\n  const v = load(q);\n  return <p id={v}>Don't {show(v)}</p>;\n}\n",
    "g.go": 'package g\nimport "fmt"\nfunc run(q string) string {\n\tif ok(q) {\n\t\tstop(q)\n\t}\n\tv := load(q)\n\tfor q {\n\t\tstop(v)\n\t}\n\treturn v\n}\n',
    "r.rs": "use std::fs;\nfn run<'a>(q: &'a str) -> &'a str {\n    if ok(q) { stop(q); }\n    let v = load(q);\n    while ok(v) { stop(v); }\n    return v;\n}\n",
    "c.c": '#include <stdio.h>\nchar *run(char *q) {\n  if (ok(q)) { stop(q); }\n  char *v = load(q);\n  while (ok(v)) { stop(v); }\n  return v;\n}\n',
    "d.cpp": '#include <string>\nstd::string run(std::string q) {\n  if (ok(q)) { stop(q); }\n  auto v = load(q);\n  while (ok(v)) { stop(v); }\n  return v;\n}\n',
}

#: What was read off the programs by hand: (kind, name, line, name of the scope), modules aside.
NODES = {
    "p.py": [("import", "import os", 1, "p"), ("function", "run", 3, "p"), ("parameter", "q", 3, "run"), ("branch", "if", 4, "run"), ("call", "load", 5, "if"), ("variable", "v", 5, "if"), ("loop", "for", 6, "run"), ("variable", "i", 6, "for"), ("variable", "v", 7, "for"), ("return", "return", 8, "run")],
    "J.java": [("import", "import java.util.List", 1, "J"), ("class", "J", 2, "J"), ("function", "run", 3, "J"), ("parameter", "q", 3, "run"), ("branch", "if", 4, "run"), ("call", "ok", 4, "if"), ("variable", "q", 4, "if"), ("call", "load", 5, "run"), ("variable", "v", 5, "run"), ("loop", "while", 6, "run"), ("call", "stop", 6, "while"), ("return", "return", 7, "run")],
    "j.js": [("import", "from fs", 1, "j"), ("function", "run", 2, "j"), ("parameter", "q", 2, "run"), ("branch", "if", 3, "run"), ("call", "stop", 3, "if"), ("call", "load", 4, "run"), ("variable", "v", 4, "run"), ("loop", "while", 5, "run"), ("call", "stop", 5, "while"), ("return", "return", 6, "run")],
    "t.ts": [("import", "from fs", 1, "t"), ("function", "run", 2, "t"), ("parameter", "q", 2, "run"), ("branch", "if", 3, "run"), ("call", "stop", 3, "if"), ("call", "load", 4, "run"), ("variable", "v", 4, "run"), ("loop", "while", 5, "run"), ("call", "stop", 5, "while"), ("return", "return", 6, "run")],
    "x.tsx": [("import", "from react", 1, "x"), ("function", "run", 2, "x"), ("parameter", "q", 2, "run"), ("branch", "if", 3, "run"), ("call", "stop", 3, "if"), ("call", "load", 4, "run"), ("variable", "v", 4, "run"), ("return", "return", 5, "run"), ("call", "show", 5, "run")],
    "g.go": [("import", "import fmt", 2, "g"), ("function", "run", 3, "g"), ("parameter", "q", 3, "run"), ("branch", "if", 4, "run"), ("call", "ok", 4, "if"), ("call", "stop", 5, "if"), ("call", "load", 7, "run"), ("variable", "v", 7, "run"), ("loop", "for", 8, "run"), ("call", "stop", 9, "for"), ("return", "return", 11, "run")],
    "r.rs": [("import", "import std::fs", 1, "r"), ("function", "run", 2, "r"), ("parameter", "q", 2, "run"), ("branch", "if", 3, "run"), ("call", "ok", 3, "if"), ("call", "stop", 3, "if"), ("call", "load", 4, "run"), ("variable", "v", 4, "run"), ("loop", "while", 5, "run"), ("call", "ok", 5, "while"), ("call", "stop", 5, "while"), ("return", "return", 6, "run")],
    "c.c": [("import", "import stdio.h", 1, "c"), ("function", "run", 2, "c"), ("parameter", "q", 2, "run"), ("branch", "if", 3, "run"), ("call", "ok", 3, "if"), ("call", "stop", 3, "if"), ("call", "load", 4, "run"), ("variable", "v", 4, "run"), ("loop", "while", 5, "run"), ("call", "ok", 5, "while"), ("call", "stop", 5, "while"), ("return", "return", 6, "run")],
    "d.cpp": [("import", "import string", 1, "d"), ("function", "run", 2, "d"), ("parameter", "q", 2, "run"), ("branch", "if", 3, "run"), ("call", "ok", 3, "if"), ("call", "stop", 3, "if"), ("call", "load", 4, "run"), ("variable", "v", 4, "run"), ("loop", "while", 5, "run"), ("call", "ok", 5, "while"), ("call", "stop", 5, "while"), ("return", "return", 6, "run")],
}
#: Names at both ends of the data flow inside each program.
FLOWS = {
    "p.py": [("i", "v"), ("load", "v"), ("q", "i"), ("q", "load"), ("v", "return")],
    "J.java": [("load", "v"), ("q", "load"), ("q", "ok"), ("q", "q"), ("v", "return"), ("v", "stop")],
    "j.js": [("load", "v"), ("q", "load"), ("q", "stop"), ("v", "return"), ("v", "stop")],
    "t.ts": [("load", "v"), ("q", "load"), ("q", "stop"), ("v", "return"), ("v", "stop")],
    "x.tsx": [("load", "v"), ("q", "load"), ("q", "stop"), ("v", "return"), ("v", "show")],
    "g.go": [("load", "v"), ("q", "load"), ("q", "ok"), ("q", "stop"), ("v", "return"), ("v", "stop")],
    "r.rs": [("load", "v"), ("q", "load"), ("q", "ok"), ("q", "stop"), ("v", "ok"), ("v", "return"), ("v", "stop")],
    "c.c": [("load", "v"), ("q", "load"), ("q", "ok"), ("q", "stop"), ("v", "ok"), ("v", "return"), ("v", "stop")],
    "d.cpp": [("load", "v"), ("q", "load"), ("q", "ok"), ("q", "stop"), ("v", "ok"), ("v", "return"), ("v", "stop")],
}


def values(table: dict[str, list[tuple]]) -> str:
    """The rows of ``NODES`` or ``FLOWS`` as a list of SQL values, after their file."""
    text = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({', '.join(map(text, (file, *row)))})" for file, rows in table.items() for row in rows)

"""Random projects made of the pieces the operators are sensitive to."""

from __future__ import annotations

import random

NAMES = ["A", "A1", "A_B", "AB", "B", "C9", "D", "E_", "Z"]
LIMIT = 120
DOCKER = [
    "FROM x", "from  y AS b", "FROM", "ENV {n}=1 {m}=2", "env {n} some value", "ENV {n}=a \\", "  {m}=2 lower=3",
    "ARG {n}", "arg {n}=$" "{m}", "ARG {n} {m}", "RUN ${n} $" "{{{m}}} $" "{{U_{n}:-d}}", "# ${n}", "# c \\", "", "\t",
    "RUN a \\ ", "\\", "COPY \\\\", "ENV　{n}=1", "RUN echo ${n}${m} $Mixed", " ARG {n}",
]
CODE = {
    "js": ["process.env.{n}", "f(process.env[\"{n}\"], process.env['{m}'])", "process.env[x]", "process.env.Mixed"],
    "go": ['os.Getenv("{n}")', 'x, ok := os.LookupEnv("{n}"); os.Getenv("{m}")', "os.Getenv(y)"],
    "py": ['os.getenv("{n}")', "os.environ['{n}'] + os.environ[\"{m}\"]", 'os.getenv("{n}", 1)'],
}
CODE["ts"] = CODE["js"]
ENV = ["{n}=1", " {n} = a=b", "# {n}=1", "export {n}=1", "lower=1", "", "{n}", "{n}=", " {n}=x", "{n}-x=1"]
PATHS = [
    "src/a.js", "src/a/b.ts", "src-x/a.go", "src.y/a.py", "src/z.py", "a.js", "Dockerfile", "svc/Dockerfile",
    "svc/Dockerfile.prod", "svc.dockerfile", "svc/Dockerfile.py", "Dockerfile.js", "vendor/a.js", "gen/b.js",
    "docs/readme.md", "src/.git/c.js", "src/B.JS", "src a/c.js", "pkg/d.go",
]


def _text(rng: random.Random, lines: list[str], count: int) -> str | None:
    if rng.random() < 0.06:
        return None
    text = ""
    for _ in range(rng.randint(0, count)):
        text += rng.choice(lines).format(n=rng.choice(NAMES), m=rng.choice(NAMES))
        if rng.random() < 0.05:
            text += "x" * (LIMIT + rng.randint(-40, 2))
        text += rng.choice(["\n", "\n", "\n", "\r\n", "\n\n"])
    return text if rng.random() < 0.5 else text.rstrip("\n")


def random_fleet(seed: int, projects: int) -> dict[str, tuple[list, list]]:
    """project -> (files, env files), as ``brute.audit`` takes them."""
    rng = random.Random(seed)
    fleet = {}
    for p in range(projects):
        files = []
        for path in rng.sample(PATHS, rng.randint(0, len(PATHS))):
            name, ext = path.split("/")[-1], path.rsplit(".", 1)[-1]
            lines = DOCKER if name.startswith("Dockerfile") or ext == "dockerfile" else CODE.get(ext, CODE["js"])
            if lines is DOCKER and rng.random() < 0.7:
                lines = [*DOCKER, *["FROM x"] * 8]
            files.append((f"p{p}/{path}", _text(rng, lines, 9)))
        env = [(f".env{n}", _text(rng, ENV, 6)) for n in range(rng.choice([0, 1, 1, 2, 3]))]
        fleet[f"p{p}"] = (files, env)
    return fleet


def tables_of(spark, fleet):
    from helpers import ENV_FILES, FILES

    files = [(p, path, text) for p, (fs, _) in fleet.items() for path, text in fs]
    env = [(p, n, path, text) for p, (_, es) in fleet.items() for n, (path, text) in enumerate(es)]
    return spark.createDataFrame(files, FILES), spark.createDataFrame(env, ENV_FILES)

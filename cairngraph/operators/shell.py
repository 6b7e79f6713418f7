"""Shell scripts, line by line: variables read and written, files sourced, commands, changes to the host."""

from __future__ import annotations

import re
import shlex
from collections.abc import Iterator, Sequence

from cairngraph.operators.base import Context, observation, resolve, slug

NAME = "cairn-shell"
# Words and verbs of the shell and of tools that change their host.
CONTROL = frozenset("[[ case do done elif else esac fi for function if select then until while { } ! ( )".split())
BREW = frozenset("install reinstall uninstall upgrade tap untap".split())
NIX_PROFILE = frozenset("install remove upgrade".split())
LAUNCHCTL = frozenset("bootstrap bootout disable enable kickstart load remove start stop unload".split())
SUDO_WITH_VALUE = frozenset("-C -g -h -p -T -u".split())

_ASSIGN = re.compile(r"([A-Za-z_]\w*)=(.*)", re.S)
_READ = re.compile(r"\$\{?([A-Za-z_]\w*)")


def command_line(raw: str) -> str:
    """The line without comments; empty for a comment."""
    line = raw.strip()
    return "" if line.startswith("#") else re.split(r"\s#", line)[0].rstrip()


def words(line: str) -> list[str]:
    """POSIX words; none where quoting is broken."""
    try:
        return shlex.split(line, posix=True)
    except ValueError:
        return []


def tool(command: str) -> str:
    return command.rpartition("/")[2]


def shown(argv: Sequence[str]) -> str:
    return f"{tool(argv[0])} {argv[1]}" if len(argv) > 1 and not argv[1].startswith("-") else tool(argv[0])


def without_sudo(argv: Sequence[str]) -> tuple[list[str], bool]:
    if not argv or tool(argv[0]) != "sudo":
        return list(argv), False
    rest = list(argv[1:])
    while rest and rest[0].startswith("-"):
        option = rest.pop(0)
        if option in SUDO_WITH_VALUE and rest:
            rest.pop(0)
    return rest, True


def _touches_host(name: str, argv: Sequence[str], privileged: bool) -> bool:
    operands, folders, todo = [], [], list(argv[1:])
    while todo:
        w = todo.pop(0)
        if w == "--":
            operands += todo
            break
        if w in ("-t", "--target-directory") and todo:
            folders.append(todo.pop(0))
        elif w.startswith("--target-directory="):
            folders.append(w.partition("=")[2])
        elif not w.startswith("-"):
            operands.append(w)
    if not operands and not folders:
        return False
    reached = {"rm": operands, "mv": operands + folders, "cp": folders or operands[1:][-1:]}[name]
    return privileged or any(p.startswith(("/", "~")) for p in reached)


def host_mutation(argv: Sequence[str]) -> dict | None:
    """category, tool, reason, privileged and effective_argv of a command that changes its host."""
    own, privileged = without_sudo(argv)
    if not own:
        return None
    name, verb, third = tool(own[0]), (own + [""])[1], (own + ["", ""])[2]
    category = None
    if name == "brew" and verb in BREW:
        category, reason = "package-management", f"brew {verb}"
    elif name == "nix" and verb == "profile" and third in NIX_PROFILE:
        category, reason = "package-management", f"nix profile {third}"
    elif name == "launchctl" and verb in LAUNCHCTL:
        category, reason = "service-management", f"launchctl {verb}"
    elif name == "darwin-rebuild" and verb == "switch":
        category, reason = "system-activation", "darwin-rebuild switch"
    elif name in ("cp", "mv", "rm") and _touches_host(name, own, privileged):
        category, reason = "filesystem-mutation", f"{name} host filesystem path"
    return category and {"category": category, "tool": name, "reason": reason, "privileged": privileged, "effective_argv": own}


def extract(path: str, content: str, context: Context) -> Iterator[dict]:
    for n, raw in enumerate(content.splitlines(), 1):
        line = command_line(raw)
        argv = words(line) if line else []
        if not argv:
            continue
        make = lambda kind, source, name, target, /, **m: observation(kind, path, source, NAME, line=n, name=name, target=target, raw=raw.strip(), **m)  # noqa: E731, B023
        writes = []
        while argv and (m := _ASSIGN.fullmatch(argv[0])):
            writes.append(m.groups())
            argv = argv[1:]
        for variable, value in writes:
            yield make("shell.env", f"env-write:{n}:{slug(variable)}", variable, f"env:{variable}", operation="write", variable=variable, value=value, scope="command" if argv else "shell")
        for variable in dict.fromkeys(_READ.findall(line)):
            yield make("shell.env", f"env-read:{n}:{slug(variable)}", variable, f"env:{variable}", operation="read", variable=variable)
        if not argv or argv[0] in CONTROL:
            continue
        if argv[0] in ("source", "."):
            where = argv[1] if len(argv) > 1 and not set(argv[1]) & set("$`*?[") else None
            if where and (inside := resolve(path, where)):
                yield make("shell.source", f"source:{n}:{slug(inside)}", where, f"file:{inside}", argv=argv, source=where, resolved_path=inside)
                continue
        yield make("shell.command", f"call:{n}:{slug(shown(argv))}", shown(argv), f"tool:{tool(argv[0])}", argv=argv, command=argv[0])
        if found := host_mutation(argv):
            own = found["effective_argv"]
            name = found["tool"] if found["category"] == "filesystem-mutation" else found["reason"] if found["tool"] == "nix" else shown(own)
            yield make("shell.host_mutation", f"host-mutation:{n}:{slug(found['category'] + '-' + name)}", name, f"host:{found['category']}", argv=argv, **found)

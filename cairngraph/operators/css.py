"""Style sheets: rules, selectors, custom properties, declarations and references; and which elements
of an HTML page a locally linked sheet's selectors name."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairngraph.functions import keys as K
from cairngraph.operators.base import OBSERVATIONS, VERSION, Context, observation, reference_target, secret_name, summary

NAME = "cairn-css"
PARSER, MODE = "cairn-css", "static-scanner-no-cascade"
_URL = re.compile(r"url\(\s*([\"']?)(.*?)\1\s*\)", re.I | re.S)


def stripped(content: str) -> str:
    """Comments as blanks, lines kept."""
    return re.sub(r"/\*.*?(\*/|$)", lambda m: re.sub(r"[^\n]", " ", m[0]), content, flags=re.S)


def blocks(text: str, at: int, end: int) -> Iterator[tuple[int, str, int, int]]:
    """(start, prelude, body start, body end) of the blocks between at and end; statements have body (-1, -1)."""
    start, i, quote = at, at, ""
    while i < end:
        c = text[i]
        if quote:
            quote = "" if c == quote and text[i - 1] != "\\" else quote
        elif c in "\"'":
            quote = c
        elif c == ";":
            if text[start:i].strip():
                yield start, text[start:i].strip(), -1, -1
            start = i + 1
        elif c == "{":
            depth, j = 1, i + 1
            while j < end and depth:
                depth += (text[j] == "{") - (text[j] == "}")
                j += 1
            yield start, text[start:i].strip(), i + 1, j - 1 if not depth else -2
            start = i = j
            continue
        i += 1
    if text[start:end].strip():
        yield start, text[start:end].strip(), -1, -1


def compound(selector: str) -> dict | None:
    """tag, classes and ids of a plain compound selector; None for anything else."""
    m = re.fullmatch(r"([A-Za-z][\w-]*|\*)?((?:[.#][\w-]+)*)", selector)
    if not m or not selector:
        return None
    parts = re.findall(r"[.#][\w-]+", m[2])
    return {"tag": None if m[1] in (None, "*") else m[1].lower(), "classes": [p[1:] for p in parts if p[0] == "."], "ids": [p[1:] for p in parts if p[0] == "#"]}


def selector_parts(s: str) -> dict:
    bare = re.sub(r"\[[^\]]*\]", "", s)
    pseudo = re.findall(r"::?[\w-]+(?:\([^)]*\))?", bare)
    plain = re.sub(r"::?[\w-]+(?:\([^)]*\))?", "", bare)
    return {
        "classes": re.findall(r"\.([\w-]+)", plain), "ids": re.findall(r"#([\w-]+)", plain), "element_names": re.findall(r"(?<![\w.#-])([A-Za-z][\w-]*)", plain), "attributes": re.findall(r"\[\s*([\w-]+)", s),
        "pseudo_classes": [p for p in pseudo if not p.startswith("::")], "pseudo_elements": [p for p in pseudo if p.startswith("::")],
        "selector_kind": "complex" if re.search(r"[>+~]", plain) else "descendant" if re.search(r"\S\s+\S", plain.strip()) else "compound",
    }


def extract(path: str, content: str, context: Context) -> Iterator[dict]:
    text, out, counts = stripped(content), [], {}
    document = K.within("css.document", path)
    make = lambda kind, source, /, **kw: observation(f"css.{kind}", path, source, NAME, kw.pop("confidence", "extracted"), format="css", parser=PARSER, parser_mode=MODE, **kw)
    line = lambda at: text.count("\n", 0, at + len(text[at:]) - len(text[at:].lstrip())) + 1

    def reference(value: str, kind: str, where: int, pointer: str, source: str, prop: str | None = None) -> None:
        n = counts["ref"] = counts.get("ref", 0) + 1
        data = value.lower().startswith("data:")
        target, what, reason = (K.unknown("css.reference", "data-url-redacted"), "data", "data-url") if data else reference_target(path, value)
        out.append(make("reference", f"css-reference:{n}", confidence="heuristic", line=line(where), name=pointer, target=target, source_key=source, rule_pointer=pointer, property_name=prop, reference_kind=what,
                        source_kind=kind, resolution_reason=reason, raw_value_summary="data:<redacted>" if data else summary(value, 120), redacted=data))

    def scan(at: int, end: int, parent: str) -> None:
        for start, prelude, a, b in blocks(text, at, end):
            word = re.match(r"@([\w-]+)", prelude)
            kind = {"media": "media", "supports": "supports", "font-face": "font-face", "import": "import"}.get(word[1], "at-rule") if word else "rule"
            if a == -1 and not word:
                out.append(make("parse_error", f"css-parse-error:{start}", confidence="unknown", line=line(start), error_kind="stray-text", recovered=True))
                continue
            if b == -2:
                out.append(make("parse_error", f"css-parse-error:{start}", confidence="unknown", line=line(start), error_kind="unclosed-block", recovered=True))
                b = end
            n = counts[parent, kind] = counts.get((parent, kind), 0) + 1
            pointer = f"{parent}/{kind}[{n}]"
            key = K.within("css.rule", path, pointer)
            inner = [] if a < 0 or kind in ("media", "supports") else [x for x in blocks(text, a, b)]
            nested = [x for x in inner if x[2] >= 0]
            for x in nested:
                out.append(make("parse_error", f"css-parse-error:{x[0]}", confidence="unknown", line=line(x[0]), error_kind="nested-style-rule", recovered=True))
            declared = [(s, *(v.strip() for v in d.split(":", 1))) for s, d, body, _ in inner if body < 0 and ":" in d]
            out.append(make("rule", f"css-rule:{pointer}", line=line(start), name=pointer, target=key, rule_pointer=pointer, rule_type=kind, selector_text=None if word else prelude, at_rule_name=word and word[1],
                            at_rule_prelude_summary=summary(prelude[len(word[0]) :]) if word else None, declaration_count=len(declared), custom_property_names=[p for _, p, _ in declared if p.startswith("--")],
                            parent_rule_pointer=parent or None, identity_mode="pointer"))
            if not word:
                for i, s in enumerate(x.strip() for x in re.split(r",(?![^(\[]*[)\]])", prelude)):
                    p = f"{pointer}/selector[{i + 1}]"
                    out.append(make("selector", f"css-selector:{p}", line=line(start), name=s, target=K.within("css.selector", path, p), source_key=key, selector_pointer=p, rule_pointer=pointer, selector_text=s, selector_index=i, **selector_parts(s)))
            if kind == "import" and (m := _URL.search(prelude) or re.search(r"([\"'])(.*?)\1", prelude)):
                reference(m[2], "import", start, pointer, key)
            for s, prop, value in declared:
                hidden = secret_name(prop)
                if prop.startswith("--"):
                    out.append(make("custom_property", f"css-property:{pointer}:{prop}", line=line(s), name=prop, target=K.within("css.custom_property", path, prop), source_key=key, property_name=prop, rule_pointer=pointer,
                                    value_summary=None if hidden else summary(value), redacted=hidden, redaction_reason="secret-prone-key" if hidden else None))
                else:
                    out.append(make("declaration", f"css-declaration:{pointer}:{prop}:{s}", line=line(s), name=prop, property_name=prop, rule_pointer=pointer, value_summary="data:<redacted>" if "data:" in value else summary(value)))
                for m in _URL.finditer(value):
                    reference(m[2], "declaration", s, pointer, key, prop)
            if kind in ("media", "supports") and a >= 0:
                scan(a, b, pointer)

    scan(0, len(text), "")
    count = lambda k: sum(o["kind"] == f"css.{k}" for o in out)
    yield make("document", "css-document", target=document, source_kind="file", rule_count=count("rule"), selector_count=count("selector"), custom_property_count=count("custom_property"), reference_count=count("reference"), parse_error_count=count("parse_error"))
    yield from out


def selector_matches(observations: DataFrame) -> DataFrame:
    """`css.selector_match` observations: elements that the selectors of a locally linked sheet name.

    An equi-join on the pair of files, then a join on the one thing that the selector's last part must have
    (an id, a class or a tag), then plain predicates. A descendant's ancestor is found by joining the
    prefixes of the element's pointer, which are as many as it is deep."""
    meta = lambda n: F.get_json_object("metadata", f"$.{n}")
    sheets = observations.where("kind = 'html.asset' AND target LIKE 'file:%'").where(F.col("target").endswith(".css")).select(F.col("path").alias("html"), F.expr("url_decode(substring(target, 6))").alias("css"), F.col("source_id").alias("sheet")).dropDuplicates(["html", "css"])
    words = F.split(F.trim(meta("selector_text")), r"\s+")
    usable = ~F.regexp_like(meta("selector_text"), F.lit(r"[>+~\[\]:*]")) & (F.size(words) <= 2)
    part = lambda w: F.struct(F.lower(F.regexp_extract(w, r"^([A-Za-z][\w-]*)", 1)).alias("tag"), F.regexp_extract_all(w, F.lit(r"\.([\w-]+)"), F.lit(1)).alias("classes"), F.regexp_extract_all(w, F.lit(r"#([\w-]+)"), F.lit(1)).alias("ids"))
    selectors = observations.where("kind = 'css.selector'").where(usable).select(F.col("path").alias("css"), F.col("target").alias("selector"), meta("selector_text").alias("selector_text"), part(F.element_at(words, -1)).alias("last"), F.when(F.size(words) == 2, part(words[0])).alias("above"))
    el = observations.where("kind = 'html.element'").select(F.col("path").alias("html"), F.col("target").alias("element"), meta("pointer").alias("pointer"), meta("tag").alias("tag"), meta("id").alias("id"), (meta("id_is_unique") == "true").alias("unique"), F.coalesce(F.from_json(meta("classes"), "array<string>"), F.array().cast("array<string>")).alias("classes"))
    anchor = lambda tag, classes, i: F.when(i.isNotNull() & (i != ""), F.concat(F.lit("#"), i)).when(F.size(classes) > 0, F.concat(F.lit("."), classes[0])).otherwise(tag)
    wanted = sheets.join(selectors, "css").withColumn("hook", anchor(F.col("last.tag"), F.col("last.classes"), F.get(F.col("last.ids"), F.lit(0)))).where("hook <> ''")
    hooks = F.array_distinct(F.concat(F.array(F.col("tag")), F.transform("classes", lambda c: F.concat(F.lit("."), c)), F.when(F.col("id").isNotNull(), F.array(F.concat(F.lit("#"), F.col("id")))).otherwise(F.array().cast("array<string>"))))
    held = el.withColumn("hook", F.explode(hooks))
    fits = lambda p: (
        ((F.col(f"{p}.tag") == "") | (F.col(f"{p}.tag") == F.col("tag"))) & (F.size(F.array_except(F.col(f"{p}.classes"), F.col("classes"))) == 0)
        & ((F.size(f"{p}.ids") == 0) | ((F.size(f"{p}.ids") == 1) & (F.get(F.col(f"{p}.ids"), F.lit(0)) == F.col("id")) & F.coalesce(F.col("unique"), F.lit(False))))
    )
    got = wanted.join(held, ["html", "hook"]).where(F.coalesce(fits("last"), F.lit(False)))
    simple = got.where("above IS NULL")
    steps = F.transform(F.sequence(F.lit(2), F.size(F.split("pointer", "/")) - 1), lambda n: F.array_join(F.slice(F.split("pointer", "/"), 1, n), "/"))
    deep = got.where("above IS NOT NULL AND size(split(pointer, '/')) > 2").select("html", "css", "sheet", "selector", "selector_text", "above", "element", F.col("pointer").alias("at"), F.explode(steps).alias("pointer"))
    under = deep.join(el.drop("element"), ["html", "pointer"]).where(F.coalesce(fits("above"), F.lit(False))).select("html", "css", "sheet", "selector", "selector_text", "element", F.col("at").alias("pointer"), F.lit("descendant").alias("how")).distinct()
    found = simple.select("html", "css", "sheet", "selector", "selector_text", "element", "pointer", F.lit("simple").alias("how")).unionByName(under)
    body = F.struct(F.col("css").alias("css_file"), F.col("html").alias("html_file"), F.col("pointer").alias("html_pointer"), F.col("how").alias("match_kind"), F.lit(True).alias("not_runtime_style"), F.lit("linked-stylesheet").alias("scope"), F.col("selector").alias("source_key"), F.col("selector_text"), F.col("sheet").alias("stylesheet_reference_source"))
    return found.select(
        F.lit("css.selector_match").alias("kind"), F.concat(F.col("css"), F.lit("#css-match:"), F.col("selector"), F.lit(":"), F.col("html"), F.col("pointer")).alias("source_id"), F.col("css").alias("path"),
        F.when(F.col("how") == "descendant", F.lit("heuristic")).otherwise(F.lit("extracted")).alias("confidence"), F.lit(NAME).alias("extractor"), F.lit(VERSION).alias("extractor_version"), F.lit(1).alias("schema_version"),
        F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.col("selector_text").alias("name"), F.col("element").alias("target"), F.to_json(body).alias("metadata"),
    ).select(*(f.split()[0] for f in OBSERVATIONS.split(",")))

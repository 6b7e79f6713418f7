"""A query for each family of extractors: small files, one of each a supplier, are classified, given to their extractors and
come back as observations. The SQL beside it lists what the files tell, line by line; the lists were recorded from a run and
then read through, so they hold what is meant and guard it from change.

`@n` stands for the supplier's number in paths, contents and expectations; digests of 64 digits are shown as `#`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairngraph.sources import repository
from cairngraph.shared import shared_folder, spread

#: family: (content by path, expected (path, kind, first line, name, target))
FAMILIES: dict[str, tuple[dict[str, str], list[tuple[str, str, int | None, str | None, str | None]]]] = {
    "shell": (
        {
            'a/@n.sh': '#!/bin/sh\nVAR_@n=v@n\nsource ./lib@n.sh\nsudo brew install pkg@n\ntool@n run "$HOME"\n',
        },
        [
            ('a/@n.sh', 'shell.env', 2, 'VAR_@n', 'env:VAR_@n'),
            ('a/@n.sh', 'shell.source', 3, './lib@n.sh', 'file:a/lib@n.sh'),
            ('a/@n.sh', 'shell.command', 4, 'sudo brew', 'tool:sudo'),
            ('a/@n.sh', 'shell.host_mutation', 4, 'brew install', 'host:package-management'),
            ('a/@n.sh', 'shell.env', 5, 'HOME', 'env:HOME'),
            ('a/@n.sh', 'shell.command', 5, 'tool@n run', 'tool:tool@n'),
        ],
    ),
    "python": (
        {
            'p/m@n.py': 'import os\nfrom p.other@n import x\n\nclass C@n:\n    def g(self):\n        pass\n\ndef f@n():\n    return 1\n',
            'p/other@n.py': 'x = 1\n',
        },
        [
            ('p/m@n.py', 'python.module', 1, 'p.m@n', 'python.module:p.m@n'),
            ('p/m@n.py', 'python.import', 1, 'os', 'external:python.module:os'),
            ('p/m@n.py', 'python.import', 2, 'p.other@n', 'python.module:p.other@n'),
            ('p/m@n.py', 'python.class', 4, 'C@n', 'python.class:p.m@n:C@n'),
            ('p/m@n.py', 'python.method', 5, 'g', 'python.method:p.m@n:C@n:g'),
            ('p/m@n.py', 'python.function', 8, 'f@n', 'python.function:p.m@n:f@n'),
            ('p/other@n.py', 'python.module', 1, 'p.other@n', 'python.module:p.other@n'),
        ],
    ),
    "python_tests": (
        {
            'tests/test_@n.py': 'import pytest\n\n@pytest.fixture\ndef fix@n():\n    return 1\n\n@pytest.mark.parametrize("a", [1])\ndef test_x@n(a, fix@n):\n    assert a\n',
            'u/test_@n.py': 'import unittest\nclass T@n(unittest.TestCase):\n    def test_x@n(self):\n        self.assertTrue(1)\n',
        },
        [
            ('tests/test_@n.py', 'python.module', 1, 'tests.test_@n', 'python.module:tests.test_@n'),
            ('tests/test_@n.py', 'python.import', 1, 'pytest', 'external:python.module:pytest'),
            ('tests/test_@n.py', 'python.function', 4, 'fix@n', 'python.function:tests.test_@n:fix@n'),
            ('tests/test_@n.py', 'python.function', 8, 'test_x@n', 'python.function:tests.test_@n:test_x@n'),
            ('tests/test_@n.py', 'python.test_file', None, 'test_@n.py', None),
            ('tests/test_@n.py', 'python.pytest_fixture', 4, 'fix@n', None),
            ('tests/test_@n.py', 'python.pytest_test', 8, 'test_x@n', None),
            ('tests/test_@n.py', 'python.test_parametrize', 8, 'test_x@n', None),
            ('tests/test_@n.py', 'python.test_assertion', None, None, None),
            ('u/test_@n.py', 'python.module', 1, 'u.test_@n', 'python.module:u.test_@n'),
            ('u/test_@n.py', 'python.import', 1, 'unittest', 'external:python.module:unittest'),
            ('u/test_@n.py', 'python.class', 2, 'T@n', 'python.class:u.test_@n:T@n'),
            ('u/test_@n.py', 'python.method', 3, 'test_x@n', 'python.method:u.test_@n:T@n:test_x@n'),
            ('u/test_@n.py', 'python.test_file', None, 'test_@n.py', None),
            ('u/test_@n.py', 'python.unittest_case', 2, 'T@n', None),
            ('u/test_@n.py', 'python.test_method', 3, 'test_x@n', None),
            ('u/test_@n.py', 'python.test_assertion', None, None, None),
        ],
    ),
    "python_web": (
        {
            'web/app@n.py': 'from flask import Flask\nfrom fastapi import FastAPI, APIRouter\napp = Flask(__name__)\n\n@app.route("/r@n")\ndef r():\n    return 1\n\napi = FastAPI()\n\n@api.get("/g@n")\ndef g():\n    return 1\n',
            'w/dep@n.py': 'from fastapi import FastAPI, Depends\napp = FastAPI()\n@app.get("/x@n")\ndef f@n(u=Depends(get_user@n)):\n    return 1\n',
            'd@n/urls.py': 'from django.urls import path, include\nurlpatterns = [path("a@n/", views.index@n), path("b/", include("other@n.urls"))]\n',
            'd@n/settings.py': 'DEBUG_@n = True\nSECRET_KEY = "x"\n',
            'd@n/apps.py': 'from django.apps import AppConfig\nclass A@n(AppConfig):\n    pass\n',
            'd@n/models.py': 'from django.db import models\nclass M@n(models.Model):\n    pass\n',
        },
        [
            ('web/app@n.py', 'python.module', 1, 'web.app@n', 'python.module:web.app@n'),
            ('web/app@n.py', 'python.import', 1, 'flask', 'external:python.module:flask'),
            ('web/app@n.py', 'python.import', 2, 'fastapi', 'external:python.module:fastapi'),
            ('web/app@n.py', 'python.import', 2, 'fastapi', 'external:python.module:fastapi'),
            ('web/app@n.py', 'python.function', 6, 'r', 'python.function:web.app@n:r'),
            ('web/app@n.py', 'python.function', 12, 'g', 'python.function:web.app@n:g'),
            ('web/app@n.py', 'python.flask_app', 3, 'app', None),
            ('web/app@n.py', 'python.fastapi_app', 9, 'api', None),
            ('web/app@n.py', 'python.flask_route', 6, 'r', None),
            ('web/app@n.py', 'python.fastapi_route', 12, 'g', None),
            ('w/dep@n.py', 'python.module', 1, 'w.dep@n', 'python.module:w.dep@n'),
            ('w/dep@n.py', 'python.import', 1, 'fastapi', 'external:python.module:fastapi'),
            ('w/dep@n.py', 'python.import', 1, 'fastapi', 'external:python.module:fastapi'),
            ('w/dep@n.py', 'python.function', 4, 'f@n', 'python.function:w.dep@n:f@n'),
            ('w/dep@n.py', 'python.fastapi_app', 2, 'app', None),
            ('w/dep@n.py', 'python.fastapi_route', 4, 'f@n', None),
            ('w/dep@n.py', 'python.fastapi_dependency', 4, 'get_user@n', None),
            ('w/dep@n.py', 'python.reference', 4, 'get_user@n', 'external:python.dependency:get_user@n'),
            ('d@n/urls.py', 'python.module', 1, 'd@n.urls', 'python.module:d@n.urls'),
            ('d@n/urls.py', 'python.import', 1, 'django.urls', 'external:python.module:django.urls'),
            ('d@n/urls.py', 'python.import', 1, 'django.urls', 'external:python.module:django.urls'),
            ('d@n/urls.py', 'python.django_urlpattern', 2, 'a@n/', None),
            ('d@n/urls.py', 'python.django_view', 2, 'views.index@n', 'external:python.view:views.index@n'),
            ('d@n/urls.py', 'python.reference', 2, 'views.index@n', 'external:python.view:views.index@n'),
            ('d@n/urls.py', 'python.django_urlpattern', 2, 'b/', None),
            ('d@n/urls.py', 'python.reference', 2, 'other@n.urls', 'external:python.module:other@n.urls'),
            ('d@n/settings.py', 'python.module', 1, 'd@n.settings', 'python.module:d@n.settings'),
            ('d@n/settings.py', 'python.django_setting_reference', 1, 'DEBUG_@n', None),
            ('d@n/settings.py', 'python.django_setting_reference', 2, 'SECRET_KEY', None),
            ('d@n/settings.py', 'python.redaction', 2, 'SECRET_KEY', None),
            ('d@n/apps.py', 'python.module', 1, 'd@n.apps', 'python.module:d@n.apps'),
            ('d@n/apps.py', 'python.import', 1, 'django.apps', 'external:python.module:django.apps'),
            ('d@n/apps.py', 'python.class', 2, 'A@n', 'python.class:d@n.apps:A@n'),
            ('d@n/apps.py', 'python.django_app', 2, 'A@n', None),
            ('d@n/models.py', 'python.module', 1, 'd@n.models', 'python.module:d@n.models'),
            ('d@n/models.py', 'python.import', 1, 'django.db', 'external:python.module:django.db'),
            ('d@n/models.py', 'python.class', 2, 'M@n', 'python.class:d@n.models:M@n'),
            ('d@n/models.py', 'python.django_model', 2, 'M@n', None),
        ],
    ),
    "nix": (
        {
            'n/@n.nix': '{ pkgs }:\nlet lib = import ./lib@n.nix; in { }\n',
        },
        [
            ('n/@n.nix', 'nix.import', 2, None, 'file:n/lib@n.nix'),
        ],
    ),
    "markdown": (
        {
            'docs/@n.md': '# Title @n\n\nSee [other](other@n.md) and <http://h/@n>.\n\n## Part @n\n\n```py\nx\n```\n',
            'docs/other@n.md': '# Other @n\n',
        },
        [
            ('docs/@n.md', 'markdown.document', None, None, 'doc.page:file%3Adocs%2F@n.md'),
            ('docs/@n.md', 'markdown.heading', 1, 'Title @n', 'doc.section:file%3Adocs%2F@n.md:title-@n'),
            ('docs/@n.md', 'markdown.heading', 5, 'Part @n', 'doc.section:file%3Adocs%2F@n.md:part-@n'),
            ('docs/@n.md', 'markdown.link', 3, 'other', 'doc.page:file%3Adocs%2Fother@n.md'),
            ('docs/@n.md', 'markdown.link', 3, 'http://h/@n', 'external.url:http%3A%2F%2Fh%2F@n'),
            ('docs/@n.md', 'markdown.code_fence', 7, 'py', None),
            ('docs/other@n.md', 'markdown.document', None, None, 'doc.page:file%3Adocs%2Fother@n.md'),
            ('docs/other@n.md', 'markdown.heading', 1, 'Other @n', 'doc.section:file%3Adocs%2Fother@n.md:other-@n'),
        ],
    ),
    "json": (
        {
            'c/@n.json': '{"name": "n@n", "list": [1, 2], "token": "hush", "ref": "./r@n.json"}\n',
            'c/r@n.json': '[]\n',
        },
        [
            ('c/@n.json', 'config.document', None, None, 'config.document:file%3Ac%2F@n.json'),
            ('c/@n.json', 'config.path', None, '/name', 'config.path:file%3Ac%2F@n.json:%2Fname'),
            ('c/@n.json', 'config.path', None, '/list', 'config.path:file%3Ac%2F@n.json:%2Flist'),
            ('c/@n.json', 'config.path', None, '/token', 'config.path:file%3Ac%2F@n.json:%2Ftoken'),
            ('c/@n.json', 'config.path', None, '/ref', 'config.path:file%3Ac%2F@n.json:%2Fref'),
            ('c/@n.json', 'config.reference', None, '/ref', 'file:c/r@n.json'),
            ('c/r@n.json', 'config.document', None, None, 'config.document:file%3Ac%2Fr@n.json'),
        ],
    ),
    "toml_yaml": (
        {
            'c/@n.toml': '[tool]\nname = "n@n"\n',
            'c/@n.yaml': 'name: n@n\nitems:\n  - a\n  - b@n\n',
            'c/@n.jsonl': '{"a": 1}\n{"a": @n}\n',
        },
        [
            ('c/@n.toml', 'config.document', None, None, 'config.document:file%3Ac%2F@n.toml'),
            ('c/@n.toml', 'config.path', None, '/tool', 'config.path:file%3Ac%2F@n.toml:%2Ftool'),
            ('c/@n.toml', 'config.path', None, '/tool/name', 'config.path:file%3Ac%2F@n.toml:%2Ftool%2Fname'),
            ('c/@n.yaml', 'config.document', None, None, 'config.document:file%3Ac%2F@n.yaml'),
            ('c/@n.yaml', 'config.path', None, '/name', 'config.path:file%3Ac%2F@n.yaml:%2Fname'),
            ('c/@n.yaml', 'config.path', None, '/items', 'config.path:file%3Ac%2F@n.yaml:%2Fitems'),
            ('c/@n.jsonl', 'config.document', None, None, 'config.document:file%3Ac%2F@n.jsonl'),
            ('c/@n.jsonl', 'config.jsonl_record', 1, None, None),
            ('c/@n.jsonl', 'config.jsonl_record', 2, None, None),
            ('c/@n.jsonl', 'config.path', 1, '/a', 'config.path:file%3Ac%2F@n.jsonl:%2Fa'),
            ('c/@n.jsonl', 'config.path', 2, '/a', 'config.path:file%3Ac%2F@n.jsonl:%2Fa'),
        ],
    ),
    "xml": (
        {
            'c/@n.plist': '<?xml version="1.0"?>\n<plist version="1.0"><dict><key>Label</key><string>l@n</string></dict></plist>\n',
            'x/@n.xml': '<?xml version="1.0"?>\n<root><item id="i@n">text @n</item></root>\n',
        },
        [
            ('c/@n.plist', 'config.document', None, None, 'config.document:file%3Ac%2F@n.plist'),
            ('c/@n.plist', 'config.path', None, '/Label', 'config.path:file%3Ac%2F@n.plist:%2FLabel'),
            ('x/@n.xml', 'xml.document', None, None, 'xml.document:file%3Ax%2F@n.xml'),
            ('x/@n.xml', 'xml.element', None, '/root', 'xml.element:file%3Ax%2F@n.xml:%2Froot'),
            ('x/@n.xml', 'xml.element', None, '/root/item', 'xml.element:file%3Ax%2F@n.xml:%2Froot%2Fitem'),
            ('x/@n.xml', 'xml.attribute', None, 'id', 'xml.attribute:file%3Ax%2F@n.xml:%2Froot%2Fitem:id'),
        ],
    ),
    "packaging": (
        {
            'q@n/requirements.txt': 'flask==@n\nrequests>=2 ; python_version > "3"\n-r other@n.txt\n',
            'p@n/pyproject.toml': '[project]\nname = "n@n"\nversion = "1"\ndependencies = ["a@n>=1", "b @ https://h/x"]\n[project.optional-dependencies]\ndev = ["c"]\n[project.scripts]\ncmd@n = "m:f"\n[build-system]\nrequires = ["hatch"]\nbuild-backend = "hatchling.build"\n[tool.ruff]\nx = 1\n[dependency-groups]\ng = ["d"]\n',
            'q@n/package.json': '{"name": "n@n", "scripts": {"test": "jest"}, "dependencies": {"react": "^1"}}\n',
        },
        [
            ('q@n/requirements.txt', 'python.package_file', None, None, None),
            ('q@n/requirements.txt', 'python.requirement', 1, 'flask', None),
            ('q@n/requirements.txt', 'python.requirement', 2, 'requests', None),
            ('q@n/requirements.txt', 'python.reference', 3, 'other@n.txt', 'file:q@n/other@n.txt'),
            ('p@n/pyproject.toml', 'config.document', None, None, 'config.document:file%3Ap@n%2Fpyproject.toml'),
            ('p@n/pyproject.toml', 'config.path', None, '/project', 'config.path:file%3Ap@n%2Fpyproject.toml:%2Fproject'),
            ('p@n/pyproject.toml', 'config.path', None, '/project/name', 'config.path:file%3Ap@n%2Fpyproject.toml:%2Fproject%2Fname'),
            ('p@n/pyproject.toml', 'config.path', None, '/project/version', 'config.path:file%3Ap@n%2Fpyproject.toml:%2Fproject%2Fversion'),
            ('p@n/pyproject.toml', 'config.path', None, '/project/dependencies', 'config.path:file%3Ap@n%2Fpyproject.toml:%2Fproject%2Fdependencies'),
            ('p@n/pyproject.toml', 'config.path', None, '/project/optional-dependencies', 'config.path:file%3Ap@n%2Fpyproject.toml:%2Fproject%2Foptional-dependencies'),
            ('p@n/pyproject.toml', 'config.path', None, '/project/optional-dependencies/dev', 'config.path:file%3Ap@n%2Fpyproject.toml:%2Fproject%2Foptional-dependencies%2Fdev'),
            ('p@n/pyproject.toml', 'config.path', None, '/project/scripts', 'config.path:file%3Ap@n%2Fpyproject.toml:%2Fproject%2Fscripts'),
            ('p@n/pyproject.toml', 'config.path', None, '/project/scripts/cmd@n', 'config.path:file%3Ap@n%2Fpyproject.toml:%2Fproject%2Fscripts%2Fcmd@n'),
            ('p@n/pyproject.toml', 'config.path', None, '/build-system', 'config.path:file%3Ap@n%2Fpyproject.toml:%2Fbuild-system'),
            ('p@n/pyproject.toml', 'config.path', None, '/build-system/requires', 'config.path:file%3Ap@n%2Fpyproject.toml:%2Fbuild-system%2Frequires'),
            ('p@n/pyproject.toml', 'config.path', None, '/build-system/build-backend', 'config.path:file%3Ap@n%2Fpyproject.toml:%2Fbuild-system%2Fbuild-backend'),
            ('p@n/pyproject.toml', 'config.path', None, '/tool', 'config.path:file%3Ap@n%2Fpyproject.toml:%2Ftool'),
            ('p@n/pyproject.toml', 'config.path', None, '/tool/ruff', 'config.path:file%3Ap@n%2Fpyproject.toml:%2Ftool%2Fruff'),
            ('p@n/pyproject.toml', 'config.path', None, '/tool/ruff/x', 'config.path:file%3Ap@n%2Fpyproject.toml:%2Ftool%2Fruff%2Fx'),
            ('p@n/pyproject.toml', 'config.path', None, '/dependency-groups', 'config.path:file%3Ap@n%2Fpyproject.toml:%2Fdependency-groups'),
            ('p@n/pyproject.toml', 'config.path', None, '/dependency-groups/g', 'config.path:file%3Ap@n%2Fpyproject.toml:%2Fdependency-groups%2Fg'),
            ('p@n/pyproject.toml', 'python.pyproject', None, 'n@n', None),
            ('p@n/pyproject.toml', 'python.requirement', None, 'a@n', None),
            ('p@n/pyproject.toml', 'python.requirement', None, 'b', None),
            ('p@n/pyproject.toml', 'python.reference', None, 'https://h/x', 'external.url:https%3A%2F%2Fh%2Fx'),
            ('p@n/pyproject.toml', 'python.dependency_group', None, 'dev', None),
            ('p@n/pyproject.toml', 'python.requirement', None, 'c', None),
            ('p@n/pyproject.toml', 'python.entry_point', None, 'cmd@n', None),
            ('p@n/pyproject.toml', 'python.build_system', None, 'hatchling.build', None),
            ('p@n/pyproject.toml', 'python.requirement', None, 'hatch', None),
            ('p@n/pyproject.toml', 'python.tool_config', None, 'ruff', None),
            ('p@n/pyproject.toml', 'python.requirement', None, 'd', None),
            ('p@n/pyproject.toml', 'ecosystem.config_profile', None, 'python', None),
            ('q@n/package.json', 'config.document', None, None, 'config.document:file%3Aq@n%2Fpackage.json'),
            ('q@n/package.json', 'config.path', None, '/name', 'config.path:file%3Aq@n%2Fpackage.json:%2Fname'),
            ('q@n/package.json', 'config.path', None, '/scripts', 'config.path:file%3Aq@n%2Fpackage.json:%2Fscripts'),
            ('q@n/package.json', 'config.path', None, '/scripts/test', 'config.path:file%3Aq@n%2Fpackage.json:%2Fscripts%2Ftest'),
            ('q@n/package.json', 'config.path', None, '/dependencies', 'config.path:file%3Aq@n%2Fpackage.json:%2Fdependencies'),
            ('q@n/package.json', 'config.path', None, '/dependencies/react', 'config.path:file%3Aq@n%2Fpackage.json:%2Fdependencies%2Freact'),
            ('q@n/package.json', 'npm.package', None, 'n@n', None),
            ('q@n/package.json', 'npm.dependency', None, 'react', None),
            ('q@n/package.json', 'ecosystem.framework_hint', None, 'react', None),
            ('q@n/package.json', 'npm.script', None, 'test', None),
            ('q@n/package.json', 'ecosystem.config_profile', None, 'package_json', None),
        ],
    ),
    "html": (
        {
            'h/@n.html': '<!DOCTYPE html><html lang="en"><head><title>T @n</title><link rel="stylesheet" href="s@n.css"></head><body><h1 id="a@n">Head @n</h1><a href="http://h/@n">x</a></body></html>\n',
        },
        [
            ('h/@n.html', 'html.document', None, None, 'html.document:file%3Ah%2F@n.html'),
            ('h/@n.html', 'html.element', 1, '/html', 'html.element:file%3Ah%2F@n.html:%2Fhtml'),
            ('h/@n.html', 'html.element', 1, '/html/head', 'html.element:file%3Ah%2F@n.html:%2Fhtml%2Fhead'),
            ('h/@n.html', 'html.element', 1, '/html/head/title', 'html.element:file%3Ah%2F@n.html:%2Fhtml%2Fhead%2Ftitle'),
            ('h/@n.html', 'html.element', 1, '/html/head/link', 'html.element:file%3Ah%2F@n.html:%2Fhtml%2Fhead%2Flink'),
            ('h/@n.html', 'html.element', 1, '/html/body', 'html.element:file%3Ah%2F@n.html:%2Fhtml%2Fbody'),
            ('h/@n.html', 'html.element', 1, '/html/body/h1', 'html.element:file%3Ah%2F@n.html:%2Fhtml%2Fbody%2Fh1'),
            ('h/@n.html', 'html.element', 1, '/html/body/a', 'html.element:file%3Ah%2F@n.html:%2Fhtml%2Fbody%2Fa'),
            ('h/@n.html', 'html.asset', 1, '/html/head/link', 'file:h/s@n.css'),
            ('h/@n.html', 'html.heading', 1, '/html/body/h1', 'html.anchor:file%3Ah%2F@n.html:a@n'),
            ('h/@n.html', 'html.link', 1, '/html/body/a', 'external.url:http%3A%2F%2Fh%2F@n'),
        ],
    ),
    "css": (
        {
            'y/@n.css': ':root { --c@n: red; }\n.k@n > a { color: var(--c@n); background: url(i@n.png); }\n',
        },
        [
            ('y/@n.css', 'css.document', None, None, 'css.document:file%3Ay%2F@n.css'),
            ('y/@n.css', 'css.rule', 1, '/rule[1]', 'css.rule:file%3Ay%2F@n.css:%2Frule%5B1%5D'),
            ('y/@n.css', 'css.selector', 1, ':root', 'css.selector:file%3Ay%2F@n.css:%2Frule%5B1%5D%2Fselector%5B1%5D'),
            ('y/@n.css', 'css.custom_property', 1, '--c@n', 'css.custom_property:file%3Ay%2F@n.css:--c@n'),
            ('y/@n.css', 'css.rule', 2, '/rule[2]', 'css.rule:file%3Ay%2F@n.css:%2Frule%5B2%5D'),
            ('y/@n.css', 'css.selector', 2, '.k@n > a', 'css.selector:file%3Ay%2F@n.css:%2Frule%5B2%5D%2Fselector%5B1%5D'),
            ('y/@n.css', 'css.declaration', 2, 'color', None),
            ('y/@n.css', 'css.declaration', 2, 'background', None),
            ('y/@n.css', 'css.reference', 2, '/rule[2]', 'file:y/i@n.png'),
        ],
    ),
    "feed": (
        {
            'f/@n.xml': '<?xml version="1.0"?><rss version="2.0"><channel><title>C @n</title><link>http://h/@n</link><item><title>I @n</title><guid>g@n</guid><link>http://h/i@n</link><author>a@n</author><category>k@n</category></item></channel></rss>\n',
        },
        [
            ('f/@n.xml', 'feed.document', None, '@n.xml', 'feed.document:file%3Af%2F@n.xml'),
            ('f/@n.xml', 'feed.channel', None, 'C @n', 'feed.channel:feed.document%3Afile%253Af%252F@n.xml:link%3Ahttp%3A%2F%2Fh%2F@n'),
            ('f/@n.xml', 'feed.link', None, 'http://h/@n', 'external.url:http%3A%2F%2Fh%2F@n'),
            ('f/@n.xml', 'feed.item', None, 'I @n', 'feed.item:feed.channel%3Afeed.document%253Afile%25253Af%25252F@n.xml%3Alink%253Ahttp%253A%252F%252Fh%252F@n:id%3Ag@n'),
            ('f/@n.xml', 'feed.link', None, 'http://h/i@n', 'external.url:http%3A%2F%2Fh%2Fi@n'),
            ('f/@n.xml', 'feed.author', None, 'a@n', 'feed.author:feed.channel%3Afeed.document%253Afile%25253Af%25252F@n.xml%3Alink%253Ahttp%253A%252F%252Fh%252F@n:a@n'),
            ('f/@n.xml', 'feed.category', None, 'k@n', 'feed.category:feed.channel%3Afeed.document%253Afile%25253Af%25252F@n.xml%3Alink%253Ahttp%253A%252F%252Fh%252F@n:k@n'),
        ],
    ),
    "documents": (
        {
            't/@n.txt': 'Head @n\n\nSome text @n with http://h/@n inside.\n',
            't/@n.csv': 'a,b@n\n1,x\n2,y\n',
            't/@n.tex': '\\section{S @n}\n\\input{other@n}\nText.\n',
        },
        [
            ('t/@n.txt', 'document.text_document', None, None, 'document.file:file%3At%2F@n.txt'),
            ('t/@n.txt', 'document.reference', 3, None, 'external.url:http%3A%2F%2Fh%2F@n'),
            ('t/@n.csv', 'document.table_document', None, None, 'document.table:file%3At%2F@n.csv:%2Ftable'),
            ('t/@n.csv', 'document.table_column', None, '/table/columns/a', 'document.column:file%3At%2F@n.csv:%2Ftable%2Fcolumns%2Fa'),
            ('t/@n.csv', 'document.table_column', None, '/table/columns/b@n', 'document.column:file%3At%2F@n.csv:%2Ftable%2Fcolumns%2Fb@n'),
            ('t/@n.tex', 'document.latex_document', None, None, 'document.file:file%3At%2F@n.tex'),
            ('t/@n.tex', 'document.latex_section', 1, '/sections/1-s-@n', 'document.section:file%3At%2F@n.tex:%2Fsections%2F1-s-@n'),
            ('t/@n.tex', 'document.latex_command', 2, '/commands/input:1', 'document.latex_command:file%3At%2F@n.tex:%2Fcommands%2Finput%3A1'),
        ],
    ),
    "mail": (
        {
            'e/@n.eml': 'From: A <a@n@x.example>\nTo: b@y.example\nSubject: Hi\nMessage-ID: <m@n@x>\nDate: Mon, 1 Jan 2024 10:00:00 +0000\n\nbody http://h/@n\n',
        },
        [
            ('e/@n.eml', 'email.message', None, 'email message', 'email.message:file%3Ae%2F@n.eml:message%3A#'),
            ('e/@n.eml', 'email.address', None, None, 'email.address:addrhash%3A#'),
            ('e/@n.eml', 'email.address', None, None, 'email.address:addrhash%3A#'),
            ('e/@n.eml', 'email.part', None, '/parts/1', 'email.part:email.message%3Afile%253Ae%252F@n.eml%3Amessage%253A#:%2Fparts%2F1'),
        ],
    ),
    "ruby": (
        {
            'r/@n.rb': 'require "json"\nmodule M@n\n  class C@n < Base\n    X@n = 1\n    def g@n\n    end\n  end\nend\n',
        },
        [
            ('r/@n.rb', 'ruby.file', None, None, 'ruby.file:file%3Ar%2F@n.rb'),
            ('r/@n.rb', 'ruby.require', 1, 'json', 'external:ruby.gem:json'),
            ('r/@n.rb', 'ruby.reference', 1, 'json', 'external:ruby.gem:json'),
            ('r/@n.rb', 'ruby.module', 2, 'M@n', 'ruby.module:M@n'),
            ('r/@n.rb', 'ruby.class', 3, 'M@n::C@n', 'ruby.class:M@n%3A%3AC@n'),
            ('r/@n.rb', 'ruby.constant', 4, 'X@n', 'ruby.constant:M@n%3A%3AC@n:X@n'),
            ('r/@n.rb', 'ruby.method', 5, 'g@n', 'ruby.method:M@n%3A%3AC@n:g@n'),
        ],
    ),
    "javascript": (
        {
            'j/@n.js': 'import x from "./o@n.js";\nexport function f@n() { return 1; }\nclass C@n { m() {} }\nconst express = require("express");\nconst app = express();\napp.get("/r@n", (q, s) => s.send(1));\n',
            'j/o@n.js': 'export const x@n = 1;\n',
        },
        [
            ('j/@n.js', 'js.file', None, None, 'js.file:file%3Aj%2F@n.js'),
            ('j/@n.js', 'js.module', None, None, 'js.module:file%3Aj%2F@n.js'),
            ('j/@n.js', 'js.import', 1, './o@n.js', 'file:j/o@n.js'),
            ('j/@n.js', 'js.reference', 1, './o@n.js', 'file:j/o@n.js'),
            ('j/@n.js', 'js.export', 2, 'f@n', 'js.variable:js.module%3Afile%253Aj%252F@n.js:f@n'),
            ('j/@n.js', 'js.function', 2, 'f@n', 'js.function:js.module%3Afile%253Aj%252F@n.js:f@n'),
            ('j/@n.js', 'js.class', 3, 'C@n', 'js.class:js.module%3Afile%253Aj%252F@n.js:C@n'),
            ('j/@n.js', 'js.import', 4, 'express', 'external:js.package:express'),
            ('j/@n.js', 'js.reference', 4, 'express', 'external:js.package:express'),
            ('j/@n.js', 'node.require', 4, 'express', None),
            ('j/@n.js', 'js.variable', 4, 'express', 'js.variable:js.module%3Afile%253Aj%252F@n.js:express'),
            ('j/@n.js', 'js.variable', 5, 'app', 'js.variable:js.module%3Afile%253Aj%252F@n.js:app'),
            ('j/@n.js', 'express.app', 5, 'app', None),
            ('j/@n.js', 'express.route', 6, 'GET /r@n', None),
            ('j/@n.js', 'js.route', 6, 'GET /r@n', 'js.route:js.module%3Afile%253Aj%252F@n.js:GET%20%2Fr@n'),
            ('j/o@n.js', 'js.file', None, None, 'js.file:file%3Aj%2Fo@n.js'),
            ('j/o@n.js', 'js.module', None, None, 'js.module:file%3Aj%2Fo@n.js'),
            ('j/o@n.js', 'js.export', 1, 'x@n', 'js.variable:js.module%3Afile%253Aj%252Fo@n.js:x@n'),
            ('j/o@n.js', 'js.variable', 1, 'x@n', 'js.variable:js.module%3Afile%253Aj%252Fo@n.js:x@n'),
        ],
    ),
    "js_frameworks": (
        {
            'j/@n.test.js': 'jest.mock("x");\ndescribe("s@n", () => {\n  it("t@n", () => { expect(1).toBe(1); });\n});\n',
            'j/n@n.ts': 'import { Controller } from "@nestjs/common";\n@Controller("cats@n")\nexport class C@n {\n  @Get("x@n")\n  f() {\n  }\n}\n',
            'j/e@n.js': 'const express = require("express");\nconst app@n = express();\napp@n.use((err, req, res, next) => {});\n',
            'j/q@n.js': '$("#a@n").on("click", f);\n$.ajax({url: "http://h/x@n"});\n$("#b").tooltip@n();\n',
        },
        [
            ('j/@n.test.js', 'js.file', None, None, 'js.file:file%3Aj%2F@n.test.js'),
            ('j/@n.test.js', 'js.module', None, None, 'js.module:file%3Aj%2F@n.test.js'),
            ('j/@n.test.js', 'jest.mock', 1, 'mock', None),
            ('j/@n.test.js', 'js.test_suite', 2, 's@n', 'js.test_suite:js.module%3Afile%253Aj%252F@n.test.js:s@n'),
            ('j/@n.test.js', 'jest.suite', 2, 's@n', None),
            ('j/@n.test.js', 'js.test_case', 3, 't@n', 'js.test_case:js.test_suite%3Ajs.module%253Afile%25253Aj%25252F@n.test.js%3As@n:t@n'),
            ('j/@n.test.js', 'jest.test', 3, 't@n', None),
            ('j/@n.test.js', 'js.test_expectation', 3, None, None),
            ('j/@n.test.js', 'jest.expectation', 3, 'expect', None),
            ('j/n@n.ts', 'js.file', None, None, 'js.file:file%3Aj%2Fn@n.ts'),
            ('j/n@n.ts', 'js.module', None, None, 'js.module:file%3Aj%2Fn@n.ts'),
            ('j/n@n.ts', 'js.import', 1, '@nestjs/common', 'external:js.package:@nestjs'),
            ('j/n@n.ts', 'js.reference', 1, '@nestjs/common', 'external:js.package:@nestjs'),
            ('j/n@n.ts', 'js.export', 3, 'C@n', 'js.variable:js.module%3Afile%253Aj%252Fn@n.ts:C@n'),
            ('j/n@n.ts', 'js.class', 3, 'C@n', 'js.class:js.module%3Afile%253Aj%252Fn@n.ts:C@n'),
            ('j/n@n.ts', 'js.method', 5, 'f', 'js.method:js.class%3Ajs.module%253Afile%25253Aj%25252Fn@n.ts%3AC@n:f'),
            ('j/e@n.js', 'js.file', None, None, 'js.file:file%3Aj%2Fe@n.js'),
            ('j/e@n.js', 'js.module', None, None, 'js.module:file%3Aj%2Fe@n.js'),
            ('j/e@n.js', 'js.import', 1, 'express', 'external:js.package:express'),
            ('j/e@n.js', 'js.reference', 1, 'express', 'external:js.package:express'),
            ('j/e@n.js', 'node.require', 1, 'express', None),
            ('j/e@n.js', 'js.variable', 1, 'express', 'js.variable:js.module%3Afile%253Aj%252Fe@n.js:express'),
            ('j/e@n.js', 'js.variable', 2, 'app@n', 'js.variable:js.module%3Afile%253Aj%252Fe@n.js:app@n'),
            ('j/e@n.js', 'express.app', 2, 'app@n', None),
            ('j/e@n.js', 'express.middleware', 3, None, None),
            ('j/e@n.js', 'express.error_handler', 3, 'use', None),
            ('j/q@n.js', 'js.file', None, None, 'js.file:file%3Aj%2Fq@n.js'),
            ('j/q@n.js', 'js.module', None, None, 'js.module:file%3Aj%2Fq@n.js'),
            ('j/q@n.js', 'jquery.selector', 1, '#a@n', None),
            ('j/q@n.js', 'js.dom_selector', 1, '#a@n', None),
            ('j/q@n.js', 'jquery.event', 1, 'click', None),
            ('j/q@n.js', 'js.dom_event', 1, 'click', None),
            ('j/q@n.js', 'jquery.ajax', 2, 'ajax', 'external.url:http%3A%2F%2Fh%2Fx@n'),
            ('j/q@n.js', 'js.ajax_reference', 2, 'ajax', 'external.url:http%3A%2F%2Fh%2Fx@n'),
            ('j/q@n.js', 'jquery.selector', 3, '#b', None),
            ('j/q@n.js', 'js.dom_selector', 3, '#b', None),
            ('j/q@n.js', 'jquery.plugin_reference', 3, 'tooltip@n', None),
        ],
    ),
    "terraform": (
        {
            'k/@n.tf': 'resource "aws_x" "r@n" {\n  name = "n"\n}\nvariable "v@n" {}\nmodule "m@n" {\n  source = "./mod@n"\n}\noutput "o@n" {\n  value = 1\n}\nterraform {\n  required_version = ">= 1"\n  backend "s3" {}\n  required_providers {\n    aws = { source = "hashicorp/aws", version = "~> 5" }\n  }\n}\n',
            'k/l@n.tf': 'locals {\n  a@n = 1\n}\nprovider "p@n" {}\ndata "d" "e@n" {}\nmoved {}\n',
            'k/@n.tf.json': '{"terraform": {"required_version": ">= 1", "backend": {"s3": {}}, "required_providers": {"aws": {"source": "h/aws"}}}, "resource": {"t": {"n@n": {}}}, "locals": {"k@n": 1}, "module": {"m@n": {"source": "./x@n"}}}\n',
            'k/@n.auto.tfvars': 'v@n = "x"\n',
        },
        [
            ('k/@n.tf', 'terraform.file', None, None, None),
            ('k/@n.tf', 'terraform.resource', 1, 'aws_x.r@n', None),
            ('k/@n.tf', 'terraform.variable', 4, 'v@n', None),
            ('k/@n.tf', 'terraform.module', 5, 'm@n', None),
            ('k/@n.tf', 'terraform.reference', 6, './mod@n', 'file:k/mod@n'),
            ('k/@n.tf', 'terraform.output', 8, 'o@n', None),
            ('k/@n.tf', 'terraform.block', 11, 'terraform', None),
            ('k/@n.tf', 'terraform.required_version', 12, None, None),
            ('k/@n.tf', 'terraform.backend', 13, 's3', None),
            ('k/@n.tf', 'terraform.required_provider', 15, 'aws', None),
            ('k/@n.tf', 'terraform.reference', 15, 'hashicorp/aws', 'external:terraform.provider:hashicorp%2Faws'),
            ('k/l@n.tf', 'terraform.file', None, None, None),
            ('k/l@n.tf', 'terraform.block', 1, 'locals', None),
            ('k/l@n.tf', 'terraform.local', 2, 'a@n', None),
            ('k/l@n.tf', 'terraform.provider', 4, 'p@n', None),
            ('k/l@n.tf', 'terraform.data_source', 5, 'd.e@n', None),
            ('k/l@n.tf', 'terraform.moved', 6, 'moved', None),
            ('k/@n.tf.json', 'config.document', None, None, 'config.document:file%3Ak%2F@n.tf.json'),
            ('k/@n.tf.json', 'config.path', None, '/terraform', 'config.path:file%3Ak%2F@n.tf.json:%2Fterraform'),
            ('k/@n.tf.json', 'config.path', None, '/terraform/required_version', 'config.path:file%3Ak%2F@n.tf.json:%2Fterraform%2Frequired_version'),
            ('k/@n.tf.json', 'config.path', None, '/terraform/backend', 'config.path:file%3Ak%2F@n.tf.json:%2Fterraform%2Fbackend'),
            ('k/@n.tf.json', 'config.path', None, '/terraform/backend/s3', 'config.path:file%3Ak%2F@n.tf.json:%2Fterraform%2Fbackend%2Fs3'),
            ('k/@n.tf.json', 'config.path', None, '/terraform/required_providers', 'config.path:file%3Ak%2F@n.tf.json:%2Fterraform%2Frequired_providers'),
            ('k/@n.tf.json', 'config.path', None, '/terraform/required_providers/aws', 'config.path:file%3Ak%2F@n.tf.json:%2Fterraform%2Frequired_providers%2Faws'),
            ('k/@n.tf.json', 'config.path', None, '/terraform/required_providers/aws/source', 'config.path:file%3Ak%2F@n.tf.json:%2Fterraform%2Frequired_providers%2Faws%2Fsource'),
            ('k/@n.tf.json', 'config.path', None, '/resource', 'config.path:file%3Ak%2F@n.tf.json:%2Fresource'),
            ('k/@n.tf.json', 'config.path', None, '/resource/t', 'config.path:file%3Ak%2F@n.tf.json:%2Fresource%2Ft'),
            ('k/@n.tf.json', 'config.path', None, '/resource/t/n@n', 'config.path:file%3Ak%2F@n.tf.json:%2Fresource%2Ft%2Fn@n'),
            ('k/@n.tf.json', 'config.path', None, '/locals', 'config.path:file%3Ak%2F@n.tf.json:%2Flocals'),
            ('k/@n.tf.json', 'config.path', None, '/locals/k@n', 'config.path:file%3Ak%2F@n.tf.json:%2Flocals%2Fk@n'),
            ('k/@n.tf.json', 'config.path', None, '/module', 'config.path:file%3Ak%2F@n.tf.json:%2Fmodule'),
            ('k/@n.tf.json', 'config.path', None, '/module/m@n', 'config.path:file%3Ak%2F@n.tf.json:%2Fmodule%2Fm@n'),
            ('k/@n.tf.json', 'config.path', None, '/module/m@n/source', 'config.path:file%3Ak%2F@n.tf.json:%2Fmodule%2Fm@n%2Fsource'),
            ('k/@n.tf.json', 'config.reference', None, '/module/m@n/source', 'file:k/x@n'),
            ('k/@n.tf.json', 'terraform.file', None, None, None),
            ('k/@n.tf.json', 'terraform.required_version', None, None, None),
            ('k/@n.tf.json', 'terraform.required_provider', None, 'aws', None),
            ('k/@n.tf.json', 'terraform.reference', None, 'h/aws', 'external:terraform.provider:h%2Faws'),
            ('k/@n.tf.json', 'terraform.backend', None, 's3', None),
            ('k/@n.tf.json', 'terraform.local', None, 'k@n', None),
            ('k/@n.tf.json', 'terraform.module', None, 'm@n', None),
            ('k/@n.tf.json', 'terraform.reference', None, './x@n', 'file:k/x@n'),
            ('k/@n.tf.json', 'terraform.resource', None, 't.n@n', None),
            ('k/@n.tf.json', 'ecosystem.config_profile', None, 'terraform_json', None),
            ('k/@n.auto.tfvars', 'terraform.file', None, None, None),
            ('k/@n.auto.tfvars', 'terraform.variable', 1, 'v@n', None),
            ('k/@n.auto.tfvars', 'terraform.redaction', 1, 'v@n', None),
        ],
    ),
    "openapi": (
        {
            'o/openapi@n.yaml': 'openapi: 3.0.0\ninfo:\n  title: T@n\npaths:\n  /p@n:\n    get:\n      operationId: g@n\ncomponents:\n  schemas:\n    A@n:\n      example: 3\n      $ref: other.yaml\n',
        },
        [
            ('o/openapi@n.yaml', 'config.document', None, None, 'config.document:file%3Ao%2Fopenapi@n.yaml'),
            ('o/openapi@n.yaml', 'config.path', None, '/openapi', 'config.path:file%3Ao%2Fopenapi@n.yaml:%2Fopenapi'),
            ('o/openapi@n.yaml', 'config.path', None, '/info', 'config.path:file%3Ao%2Fopenapi@n.yaml:%2Finfo'),
            ('o/openapi@n.yaml', 'config.path', None, '/info/title', 'config.path:file%3Ao%2Fopenapi@n.yaml:%2Finfo%2Ftitle'),
            ('o/openapi@n.yaml', 'config.path', None, '/paths', 'config.path:file%3Ao%2Fopenapi@n.yaml:%2Fpaths'),
            ('o/openapi@n.yaml', 'config.path', None, '/paths/~1p@n', 'config.path:file%3Ao%2Fopenapi@n.yaml:%2Fpaths%2F~1p@n'),
            ('o/openapi@n.yaml', 'config.path', None, '/paths/~1p@n/get', 'config.path:file%3Ao%2Fopenapi@n.yaml:%2Fpaths%2F~1p@n%2Fget'),
            ('o/openapi@n.yaml', 'config.path', None, '/paths/~1p@n/get/operationId', 'config.path:file%3Ao%2Fopenapi@n.yaml:%2Fpaths%2F~1p@n%2Fget%2FoperationId'),
            ('o/openapi@n.yaml', 'config.path', None, '/components', 'config.path:file%3Ao%2Fopenapi@n.yaml:%2Fcomponents'),
            ('o/openapi@n.yaml', 'config.path', None, '/components/schemas', 'config.path:file%3Ao%2Fopenapi@n.yaml:%2Fcomponents%2Fschemas'),
            ('o/openapi@n.yaml', 'config.path', None, '/components/schemas/A@n', 'config.path:file%3Ao%2Fopenapi@n.yaml:%2Fcomponents%2Fschemas%2FA@n'),
            ('o/openapi@n.yaml', 'config.path', None, '/components/schemas/A@n/example', 'config.path:file%3Ao%2Fopenapi@n.yaml:%2Fcomponents%2Fschemas%2FA@n%2Fexample'),
            ('o/openapi@n.yaml', 'config.path', None, '/components/schemas/A@n/$ref', 'config.path:file%3Ao%2Fopenapi@n.yaml:%2Fcomponents%2Fschemas%2FA@n%2F%24ref'),
            ('o/openapi@n.yaml', 'ecosystem.config_profile', None, 'openapi', None),
            ('o/openapi@n.yaml', 'openapi.document', None, None, None),
            ('o/openapi@n.yaml', 'openapi.info', None, 'T@n', None),
            ('o/openapi@n.yaml', 'openapi.path', None, '/p@n', None),
            ('o/openapi@n.yaml', 'openapi.operation', None, 'g@n', None),
            ('o/openapi@n.yaml', 'openapi.schema', None, 'A@n', None),
            ('o/openapi@n.yaml', 'openapi.example', None, '/components/schemas/A@n/example', None),
            ('o/openapi@n.yaml', 'openapi.redaction', None, '/components/schemas/A@n/example', None),
            ('o/openapi@n.yaml', 'openapi.reference', None, 'other.yaml', None),
        ],
    ),
    "tool_configs": (
        {
            'z@n/jest.config.json': '{"a@n": 1}\n',
            'z@n/playwright.config.json': '{"a": 1}\n',
            'z@n/nest-cli.json': '{"a": 1}\n',
            'z@n/angular.json': '{"projects": {"p@n": {"architect": {"build": {}}}}}\n',
            'z@n/tsconfig.json': '{"extends": "./base@n.json"}\n',
            'z/k@n.yaml': 'apiVersion: v1\nkind: Pod\nmetadata:\n  name: pod@n\nspec:\n  image: img@n\n',
            'z/l@n.yaml': 'databaseChangeLog:\n  - changeSet:\n      id: c@n\n      author: a@n\n',
            'z/g@n.yaml': 'apiVersion: argoproj.io/v1\nkind: Application\nmetadata:\n  name: app@n\n',
        },
        [
            ('z@n/jest.config.json', 'config.document', None, None, 'config.document:file%3Az@n%2Fjest.config.json'),
            ('z@n/jest.config.json', 'config.path', None, '/a@n', 'config.path:file%3Az@n%2Fjest.config.json:%2Fa@n'),
            ('z@n/jest.config.json', 'ecosystem.config_profile', None, 'jest_config', None),
            ('z@n/jest.config.json', 'jest.config', None, 'jest.config.json', None),
            ('z@n/playwright.config.json', 'config.document', None, None, 'config.document:file%3Az@n%2Fplaywright.config.json'),
            ('z@n/playwright.config.json', 'config.path', None, '/a', 'config.path:file%3Az@n%2Fplaywright.config.json:%2Fa'),
            ('z@n/playwright.config.json', 'ecosystem.config_profile', None, 'playwright_config', None),
            ('z@n/playwright.config.json', 'playwright.config', None, 'playwright.config.json', None),
            ('z@n/nest-cli.json', 'config.document', None, None, 'config.document:file%3Az@n%2Fnest-cli.json'),
            ('z@n/nest-cli.json', 'config.path', None, '/a', 'config.path:file%3Az@n%2Fnest-cli.json:%2Fa'),
            ('z@n/nest-cli.json', 'ecosystem.config_profile', None, 'nest_config', None),
            ('z@n/nest-cli.json', 'nest.config', None, 'nest-cli.json', None),
            ('z@n/angular.json', 'config.document', None, None, 'config.document:file%3Az@n%2Fangular.json'),
            ('z@n/angular.json', 'config.path', None, '/projects', 'config.path:file%3Az@n%2Fangular.json:%2Fprojects'),
            ('z@n/angular.json', 'config.path', None, '/projects/p@n', 'config.path:file%3Az@n%2Fangular.json:%2Fprojects%2Fp@n'),
            ('z@n/angular.json', 'config.path', None, '/projects/p@n/architect', 'config.path:file%3Az@n%2Fangular.json:%2Fprojects%2Fp@n%2Farchitect'),
            ('z@n/angular.json', 'config.path', None, '/projects/p@n/architect/build', 'config.path:file%3Az@n%2Fangular.json:%2Fprojects%2Fp@n%2Farchitect%2Fbuild'),
            ('z@n/angular.json', 'ecosystem.config_profile', None, 'angular', None),
            ('z@n/angular.json', 'angular.project', None, 'p@n', None),
            ('z@n/angular.json', 'angular.target', None, 'build', None),
            ('z@n/tsconfig.json', 'config.document', None, None, 'config.document:file%3Az@n%2Ftsconfig.json'),
            ('z@n/tsconfig.json', 'config.path', None, '/extends', 'config.path:file%3Az@n%2Ftsconfig.json:%2Fextends'),
            ('z@n/tsconfig.json', 'config.reference', None, '/extends', 'file:z@n/base@n.json'),
            ('z@n/tsconfig.json', 'ecosystem.config_profile', None, 'typescript_config', None),
            ('z@n/tsconfig.json', 'typescript.config', None, 'tsconfig.json', None),
            ('z@n/tsconfig.json', 'typescript.reference', None, './base@n.json', 'file:z@n/base@n.json'),
            ('z/k@n.yaml', 'config.document', None, None, 'config.document:file%3Az%2Fk@n.yaml'),
            ('z/k@n.yaml', 'config.path', None, '/apiVersion', 'config.path:file%3Az%2Fk@n.yaml:%2FapiVersion'),
            ('z/k@n.yaml', 'config.path', None, '/kind', 'config.path:file%3Az%2Fk@n.yaml:%2Fkind'),
            ('z/k@n.yaml', 'config.path', None, '/metadata', 'config.path:file%3Az%2Fk@n.yaml:%2Fmetadata'),
            ('z/k@n.yaml', 'config.path', None, '/metadata/name', 'config.path:file%3Az%2Fk@n.yaml:%2Fmetadata%2Fname'),
            ('z/k@n.yaml', 'config.path', None, '/spec', 'config.path:file%3Az%2Fk@n.yaml:%2Fspec'),
            ('z/k@n.yaml', 'config.path', None, '/spec/image', 'config.path:file%3Az%2Fk@n.yaml:%2Fspec%2Fimage'),
            ('z/k@n.yaml', 'ecosystem.config_profile', None, 'kubernetes_json', None),
            ('z/k@n.yaml', 'kubernetes.resource', None, 'pod@n', None),
            ('z/k@n.yaml', 'docker.reference', None, 'img@n', 'external:docker.image:img@n'),
            ('z/l@n.yaml', 'config.document', None, None, 'config.document:file%3Az%2Fl@n.yaml'),
            ('z/l@n.yaml', 'config.path', None, '/databaseChangeLog', 'config.path:file%3Az%2Fl@n.yaml:%2FdatabaseChangeLog'),
            ('z/l@n.yaml', 'ecosystem.config_profile', None, 'liquibase', None),
            ('z/l@n.yaml', 'liquibase.changelog', None, 'l@n.yaml', None),
            ('z/l@n.yaml', 'liquibase.changeset', None, 'c@n', None),
            ('z/g@n.yaml', 'config.document', None, None, 'config.document:file%3Az%2Fg@n.yaml'),
            ('z/g@n.yaml', 'config.path', None, '/apiVersion', 'config.path:file%3Az%2Fg@n.yaml:%2FapiVersion'),
            ('z/g@n.yaml', 'config.path', None, '/kind', 'config.path:file%3Az%2Fg@n.yaml:%2Fkind'),
            ('z/g@n.yaml', 'config.path', None, '/metadata', 'config.path:file%3Az%2Fg@n.yaml:%2Fmetadata'),
            ('z/g@n.yaml', 'config.path', None, '/metadata/name', 'config.path:file%3Az%2Fg@n.yaml:%2Fmetadata%2Fname'),
            ('z/g@n.yaml', 'ecosystem.config_profile', None, 'argocd', None),
            ('z/g@n.yaml', 'argocd.application', None, 'app@n', None),
        ],
    ),}


def _column(template: str) -> Column:
    first, *rest = template.split("@n")
    return F.concat(F.lit(first), *(x for r in rest for x in (F.col("n").cast("string"), F.lit(r))))


def _sql(value: str | int | None) -> str:
    if value is None or isinstance(value, int):
        return "NULL" if value is None else str(value)
    return " || n || ".join("'" + part.replace("'", "''") + "'" for part in value.split("@n"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers over all tasks: they come from one small file, and extractors work in Python on all that is made of them."""
    return spread(spark.read.parquet(f"{sf_dir}/supplier.parquet"))


def _files(suppliers: DataFrame, files: dict[str, str]) -> DataFrame:
    each = F.array(*(F.struct(_column(p).alias("path"), _column(c).alias("content")) for p, c in files.items()))
    return suppliers.select(F.col("s_suppkey").cast("string").alias("n")).select(F.explode(each).alias("f")).select("f.path", F.encode("f.content", "UTF-8").alias("content"), F.lit(False).alias("executable"))


def observed(suppliers: DataFrame, files: dict[str, str]) -> DataFrame:
    """What the extractors tell of the files, beside the fact that they are there."""
    found = repository.observe(repository.classify(_files(suppliers, files))).where("kind <> 'file'")
    return found.select("path", "kind", "start_line", "name", F.regexp_replace("target", "[0-9a-f]{64}", "#").alias("target"))


def _query(files: dict[str, str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: observed(suppliers(spark, sf_dir), files)


def _expected(rows: list[tuple]) -> str:
    each = (f"SELECT {_sql(p)} AS path, '{kind}' AS kind, {_sql(line)}::INT AS start_line, {_sql(name)} AS name, {_sql(target)} AS target FROM t" for p, kind, line, name, target in rows)
    return f"WITH t AS (SELECT s_suppkey::VARCHAR AS n FROM supplier) {' UNION ALL '.join(each)}"


QUERIES = {f"extract_{name}": _query(files) for name, (files, _) in FAMILIES.items()}
SQL = {f"extract_{name}": _expected(rows) for name, (_, rows) in FAMILIES.items()}


# --- selectors matched with pages -----------------------------------------------------------------------------

_PAGES = {
    "h/@n.html": '<html><head><link rel="stylesheet" href="../y/@n.css"></head><body><p class="k@n" id="i@n">x</p><div><a class="m">y</a></div></body></html>',
    "y/@n.css": ".k@n { color: red }\n#i@n { color: red }\ndiv a.m { color: blue }\n#none { x: y }\np:hover { a: b }\n",
}
_MATCHES = [
    ("y/@n.css", ".k@n", "html.element:file%3Ah%2F@n.html:%2Fhtml%2Fbody%2Fp"),
    ("y/@n.css", "#i@n", "html.element:file%3Ah%2F@n.html:%2Fhtml%2Fbody%2Fp"),
    ("y/@n.css", "div a.m", "html.element:file%3Ah%2F@n.html:%2Fhtml%2Fbody%2Fdiv%2Fa"),
]


def selector_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repository.observe(repository.classify(_files(suppliers(spark, sf_dir), _PAGES)))
    path = shared_folder(spark, "observations")
    rows.write.parquet(path)  # matching looks at them several times
    found = repository.with_selector_matches(spark.read.schema(rows.schema).parquet(path))
    return found.where("kind = 'css.selector_match'").select("path", "name", "target")


QUERIES["extract_selector_matches"] = selector_matches
SQL["extract_selector_matches"] = "WITH t AS (SELECT s_suppkey::VARCHAR AS n FROM supplier) " + " UNION ALL ".join(f"SELECT {_sql(p)} AS path, {_sql(n)} AS name, {_sql(t)} AS target FROM t" for p, n, t in _MATCHES)

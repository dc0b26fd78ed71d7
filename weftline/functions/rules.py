"""Rule tables as data, and expressions that find the first rule a text meets.

A rule set is an ordered list of categories with literals. The order decides which
reason a text gets, not where in the text the literal stands. Both engines get their
conditions from the same tables: ``first_reason`` for Spark, ``reason_sql`` for SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Literals of the rule layers, in the order in which they are tried.
FRAMEWORK = {
    "django_migration": [
        "migrations.RunPython", "apps.get_model(", "class Migration(migrations.Migration)", "from django.db import migrations", "schema_editor",
        "migrations.AddField", "migrations.RemoveField", "migrations.AlterField", "migrations.CreateModel", "migrations.DeleteModel", "migrations.RenameField",
    ],
    "django_model": [
        "models.CharField(", "models.TextField(", "models.IntegerField(", "models.BooleanField(", "models.DateField(", "models.DateTimeField(",
        "models.ForeignKey(", "models.OneToOneField(", "models.ManyToManyField(", "models.EmailField(", "models.URLField(", "models.FileField(",
        "models.ImageField(", "models.DecimalField(", "models.FloatField(", "models.AutoField(", "models.SlugField(", "models.JSONField(", "models.UUIDField(",
    ],
    "django_meta": ["class Meta:", "verbose_name", "db_table", "unique_together", "index_together", "ordering =", "permissions ="],
    "django_admin": [
        "admin.ModelAdmin", "admin.site.register", "admin.TabularInline", "admin.StackedInline", "list_display =", "search_fields =",
        "list_filter =", "admin.register(", "class Media:", "class MediaDefiningClass",
    ],
    "django_config": [
        "SECRET_KEY =", "DEBUG = True", "DATABASES =", "INSTALLED_APPS =", "MIDDLEWARE =", "AUTH_PASSWORD_VALIDATORS", "TEMPLATES =", "STATIC_URL =",
        "LANGUAGE_CODE =", "WSGI_APPLICATION =", "ROOT_URLCONF =", "ALLOWED_HOSTS =", "AUTH_USER_MODEL =", "LOGIN_URL =", "REST_FRAMEWORK =", "CELERY_BROKER_URL",
    ],
    "plotly": [
        "_plotly_utils", "basevalidators", "BaseValidator", "plotly_name=", "edit_type=", "parent_name=", "InfoArrayValidator", "DataArrayValidator",
        "CompoundValidator", "CompoundArrayValidator", "EnumeratedValidator", "FlaglistValidator", "AnyValidator", "DashValidator",
    ],
    "flask_fastapi": ["@app.route(", "@router.get(", "@router.post(", "@bp.route(", "@api_view(", "Flask(__name__)", "APIRouter(", "FastAPI("],
    "sqlalchemy_table": [
        "Column(String", "Column(Integer", "Column(Boolean", "Column(ForeignKey", "Column(DateTime", "declarative_base()", "__tablename__", "relationship(", "back_populates",
    ],
    "other_frameworks": ["django_filters", "rest_framework", "graphene.", "strawberry.", "factory_boy", "factory.django", "import factory"],
}
PYTHON2 = [
    "# -*- coding:", "# -*- coding", "#!-*- coding", "#!-*-coding", "#coding:", "# coding:", "from __future__ import", "unicode_literals", "print_function",
    "absolute_import", "division", "import __builtin__", "basestring", "xrange(", "unicode(", "print >>", "except Exception, e:",
]
CONFIG = ["extensions = [", "master_doc =", "html_theme =", "pygments_style =", "from setuptools import", "distutils", "setup(", "install_requires=[", "entry_points={", "package_data={"]
TESTS = [
    "import unittest", "import pytest", "from unittest import", "from pytest import", "unittest.TestCase", "pytest.mark.", "pytest.fixture", "pytest.raises",
    "def test_", "def setUp(", "def tearDown(", "def setUpClass(", "def tearDownClass(", "self.assertEqual", "self.assertTrue", "self.assertFalse", "self.assertRaises",
    "self.assertIn", "self.assertIsNone", "self.assertIsNotNone", "self.assertListEqual", "self.assertDictEqual", "mock.patch(", "MagicMock", "Mock(", "@mock.patch", "@patch(",
]
AUTOGENERATED = [
    r"\b[a-z]+_\d{4,}\b",
    r"\b[0-9a-f]{32}\b",
    r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b",
    r"\{\{.*?\}\}",
    r"\{% .*?%\}",
]
FILE_PARTS = ["migrations/", "/tests/", "/test_", "setup.py", "conftest.py", "__init__.py", "__main__.py", "manage.py", "wsgi.py", "asgi.py", "celery.py", "admin.py", "apps.py", "urls.py", "conf.py"]
FILE_GLOBS = ["*/migrations/*", "*/tests/*", "*/test/*", "*/django/*", "*/plotly/*", "*/flask*", "*/setup.py", "*/conftest.py"]
POISON = ["class Migration(migrations.Migration)", "migrations.RunPython", "models.CharField(", "_plotly_utils.basevalidators", "plotly_name=", "# -*- coding:", "from __future__ import", "unittest.TestCase", "pytest.mark.", "from setuptools import"]
PAIR_CONFIG = ["extensions = [", "master_doc =", "html_theme =", "pygments_style =", "from setuptools import", "install_requires=[", "entry_points={", "package_data={", "setup(name="]
PAIR_TESTS = ["import unittest", "from unittest import", "import pytest", "from pytest import", "unittest.TestCase", "pytest.mark.", "pytest.fixture", "pytest.raises"]
SPECIAL_TOKENS = ["<s>", "</s>", "<unk>", "<pad>", "<eos>"]
MARKERS = ["### Task", "### Code", "### Instruction", "### Response"]
EVALUATION_NAMES = ["fibonacci", "quicksort", "binary_search", "two_sum", "mergesort", "is_palindrome", "is_prime", "reverse_string", "count_vowels", "sum_list", "factorial"]
LICENCE_WORDS = [
    "copyright", "all rights reserved", "licensed under", "gnu general public license", "apache license", "mit license", "bsd license", "free software foundation",
    "spdx-license-identifier", "this program is free software", "redistribution and use", "permission is hereby granted", "this source code", "license version",
    "the free software foundation", "distributed under the terms",
]
PASSED_WORDS = ["passed", "true", "ok", "success", "1"]
STOPS = ["\ndef ", "\nclass ", "\n# ", "\n@", "\nif __name__", "\nprint("]
LOGIC = ["=", "if ", "for ", "while ", "return ", "print(", "yield "]
PAIR_LOGIC = [*LOGIC, "raise ", "assert "]


def _without(values: list[str], *out: str) -> list[str]:
    return [v for v in values if v not in out]


#: The rules for function pairs are the corpus rules with a few literals more and a few less.
PAIR_FRAMEWORK = {
    "django_migration": [*FRAMEWORK["django_migration"], "django.db.migrations", "django.apps"],
    "django_model": [*FRAMEWORK["django_model"], "models.Model", "models.CASCADE"],
    "django_meta": [*_without(FRAMEWORK["django_meta"], "ordering =", "permissions ="), "app_label"],
    "django_admin": [*_without(FRAMEWORK["django_admin"], "class Media:", "class MediaDefiningClass"), "inlines ="],
    "django_config": [*FRAMEWORK["django_config"], "django.utils", "from django."],
    "plotly": [*_without(FRAMEWORK["plotly"], "DashValidator"), "plotly.graph_objects", "plotly.io"],
    "flask_fastapi": FRAMEWORK["flask_fastapi"],
    "sqlalchemy": FRAMEWORK["sqlalchemy_table"],
    "other_framework": FRAMEWORK["other_frameworks"],
}
PAIR_PYTHON2 = _without(PYTHON2, "# -*- coding", "division", "unicode(")
PAIR_CONFIG_FULL = [*PAIR_CONFIG, "setup(name ="]
PAIR_TESTS_FULL = _without(TESTS, "Mock(")

#: (layer, literal, reason) in the order in which they are tried.
Rules = list[tuple[str, str]]


def layer(prefix: str, table: dict[str, list[str]] | list[str], width: int = 60) -> Rules:
    """Literals of a layer with the reason that each gives."""
    if isinstance(table, list):
        return [(literal, f"{prefix}:{literal[:width]}") for literal in table]
    return [(literal, f"{prefix}_{category}:{literal[:width]}") for category, literals in table.items() for literal in literals]


CORPUS_LAYERS = {"L1": layer("L1", FRAMEWORK), "L2": layer("L2_python2", PYTHON2), "L3": layer("L3_fatal", CONFIG), "L4": layer("L4_test", TESTS)}
PAIR_LAYERS = {"L1": layer("L1", PAIR_FRAMEWORK, 44), "L2": layer("L2_python2", PAIR_PYTHON2, 44), "L3": layer("L3_config", PAIR_CONFIG_FULL, 44), "L4": layer("L4_test", PAIR_TESTS_FULL, 44)}


def first_reason(text: Column, rules: Rules) -> Column:
    """Reason of the first rule whose literal the text contains, else null."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(literal)), F.lit(reason)) for literal, reason in rules])


def autogenerated_reason(text: Column, least: int = 3, width: int = 60) -> Column:
    """Reason of the first pattern that a text has ``least`` times, else null."""
    return F.coalesce(*[F.when(F.regexp_count(text, F.lit(p)) >= least, F.lit(f"L6_autogen:{p[:width]}")) for p in AUTOGENERATED])


def contains_any(text: Column, literals: list[str]) -> Column:
    found = F.lit(False)
    for literal in literals:
        found = found | F.contains(text, F.lit(literal))
    return found


def glob_regex(glob: str) -> str:
    """Regular expression of a shell pattern in which a star crosses slashes."""
    import re

    return "^" + ".*".join(re.escape(part) for part in glob.split("*")) + "$"


def file_excluded(path: Column) -> Column:
    """Paths that hold build, test or framework files."""
    found = contains_any(path, FILE_PARTS)
    for glob in FILE_GLOBS:
        found = found | path.rlike("(?s)" + glob_regex(glob))
    return found


def quoted(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def reason_sql(text: str, rules: Rules) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, {quoted(literal)}) THEN {quoted(reason)}" for literal, reason in rules) + " END"


def autogenerated_sql(text: str, least: int = 3, width: int = 60) -> str:
    return "CASE " + " ".join(f"WHEN len(regexp_extract_all({text}, {quoted(p)})) >= {least} THEN {quoted(f'L6_autogen:{p[:width]}')}" for p in AUTOGENERATED) + " END"


def any_sql(text: str, literals: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(v)})" for v in literals) + ")"


def file_excluded_sql(path: str) -> str:
    globs = " OR ".join(f"regexp_matches({path}, {quoted('(?s)' + glob_regex(g))})" for g in FILE_GLOBS)
    return f"({any_sql(path, FILE_PARTS)} OR {globs})"

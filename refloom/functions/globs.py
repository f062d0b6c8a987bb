"""File-class globs, compiled to one anchored regular expression a class."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The globs by which files are classed.
TEST_GLOBS = """
**/*.test.* **/*_test.dart **/*.spec.* **/*_test.* **/*.stories.* **/test/** **/__tests__/** **/mocks/**
**/__mocks__/** **/fixtures/** **/__fixtures__/** **/e2e/** **/test-integration/** **/__schemas__/** **/mocks.*
**/*.test-d.* **/test-utils.* **/test-utils/** **/testing/** **/*.mock.* **/tests/** **/type-tests/** **/testdata/**
**/spec/** **/cypress/** **/playwright/** **/test_driver/** **/integration_test/** **/*.fixture.* **/*.e2e.*
**/vitest.setup.* **/jest.setup.* **/setupTests.* **/test_utils.* **/test_util.* **/testutils.* **/tests-e2e/**
**/e2e-tests/**
""".split()
DOCS_GLOBS = "**/docs/** **/examples/** **/example/** **/demo/** **/blog/** **/versioned_docs/**".split()
GENERATED_GLOBS = """
**/*.g.dart **/*.pb.dart **/*.pbenum.dart **/*.pbjson.dart **/*.pbserver.dart **/*.pbgrpc.dart **/*.freezed.dart
**/*.mocks.dart **/*.over_react.g.dart **/*_generated.dart **/*.generated.* **/generated/** **/__generated__/**
""".split()
VENDORED_GLOBS = "**/third_party/** **/vendor/** **/vendored/**".split()
SCRIPT_GLOBS = """
**/playground/** **/playgrounds/** **/bench/** **/benchmark/** **/benchmarks/** **/sandbox/** **/scripts/**
**/tool/** **/tools/** **/script/** **/*.config.* **/*.workspace.*
""".split()
# Names of test-support packages, files and folders (* stands for any characters).
TEST_SUPPORT_NAMES = """
test testing testkit *testkit test_utils test-utils *_test_utils *-test-utils *_test_util *-test-util *_testing
*-testing *_testing_library *-testing-library *_test mock mocks *_mock *_mocks *-mock *-mocks e2e *-e2e *_e2e
""".split()
# Folders below a package root whose symbols support tests.
TEST_SUPPORT_DIRS = "lib/src/test*/* lib/src/mock/* lib/src/mocks/* lib/testing/* lib/mocks/* src/testing/* src/test-utils/* src/test_utils/*".split()


def path_regex(globs: list[str]) -> str:
    """Paths that any glob matches, as one pattern: folder globs and base-name globs are grouped."""
    folders = sorted(re.escape(g[3:-3]) for g in globs if g.startswith("**/") and g.endswith("/**"))
    names = sorted(re.escape(g[3:]).replace(r"\*", "[^/]*") for g in globs if g.startswith("**/") and not g.endswith("/**"))
    parts = []
    if folders:
        parts.append(f"(?:{'|'.join(folders)})/.*")
    if names:
        parts.append(f"(?:{'|'.join(names)})")
    return f"^(?:.*/)?(?:{'|'.join(parts)})$"


def name_regex(patterns: list[str], suffix: str = "") -> str:
    """Whole names that any pattern matches; * crosses everything."""
    return f"^(?:{'|'.join(re.escape(p).replace(r'\*', '.*') for p in patterns)}){re.escape(suffix)}$"


def segment_glob_regex(glob: str) -> str:
    """A path glob with segment rules: ``**/`` is any folders, ``*`` and ``?`` stay within a segment."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i]))
            i += 1
    return f"^{out}$"


def matches(path: Column, globs: list[str]) -> Column:
    return path.rlike(path_regex(globs))

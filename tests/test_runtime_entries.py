"""Runtime entries from conventions, pages, bundlers, images and scripts."""

import json

import pytest

from refloom.functions.launches import docker_files, launches, run_files, worker_files
from refloom.operators.runtime_entries import RuntimeEntries


@pytest.mark.parametrize(
    "command, want",
    [
        ("node dist/server.js", ["dist/server.js"]), ("tsx watch src/x.ts --port 3", ["src/x.ts"]), ("node -r dotenv/config x.mjs && echo y.js", ["x.mjs"]), ("node -e 'run(\"a.js\")' b.js", []),
        ("nodemon -w src -e ts x.ts", ["x.ts"]), ("nodemon --exec node y.js", ["y.js"]), ("./node_modules/.bin/tsx \"my file.ts\" | node z.cjs", ["my file.ts", "z.cjs"]), ("tsc -p x.ts; bun run a.tsx", ["a.tsx"]),
        ("deno run https://x.y/z.ts", []), ("node --import tsx q.ts", ["q.ts"]), ("echo 'open", []), ("", []),
    ],
)
def test_files_of_command_lines(command, want):
    assert list(run_files(command)) == want


def test_workers_and_images():
    assert list(worker_files("wrangler dev --local src/w.ts && wrangler pages dev x.ts; wrangler deploy 'a.mjs'")) == ["src/w.ts", "a.mjs"]
    assert list(docker_files('FROM node\nWORKDIR /app/\nHEALTHCHECK CMD node h.js\nENTRYPOINT ["node"]\nCMD ["dist/x.js", "--v"]')) == ["dist/x.js"]
    assert list(docker_files("WORKDIR /app\nCMD node \\\n  /app/s.js\nCMD node /etc/t.js")) == ["s.js"]


def test_rules_read_their_files():
    page = '<script src="/src/a.ts?x"></script><SCRIPT type=module src=\'./b.js\'></SCRIPT><script>require("./c"); import x from "/d.js"; import "vue"</script><script src="https://e/f.js"></script>'
    assert launches("index.html", page) == [("page", None, t) for t in ("src/a.ts", "./b.js", "./c", "d.js")]
    assert launches("docs/index.html", page) == [] and launches("index.html", None) == []
    vite = "export default { build: { rollupOptions: { input: { main: resolve(__dirname, 'index.html'), admin: 'admin/main.ts' } } }, x: 'no.ts' }"
    assert launches("vite.config.ts", vite) == [("bundler", None, "index.html"), ("bundler", None, "admin/main.ts")]
    assert launches("rollup.config.mjs", "input: 'src/x.js',\noutput: 'y.js'") == [("bundler", None, "src/x.js")]
    assert launches("webpack.prod.config.js", "entry: { app: './src/a', 'two': { import: ['./src/b.ts', 'lodash'], dependOn: 'app' } }, entry: './c.js'") == [("webpack", "app", "./src/a"), ("webpack", "two", "./src/b.ts"), ("webpack", "main", "./c.js")]
    assert launches("wrangler.toml", 'main = "w.ts"\n[env.x]\nmain = "no.ts"') == [("worker", None, "w.ts")]
    assert launches("wrangler.jsonc", '{"main": "a.ts", "env": {"p": {"main": "b.ts"}}}') == [("worker", None, "a.ts"), ("worker", None, "b.ts")]
    assert launches("site/.vitepress/config.mts", "import x from './theme/y'; `./${z}`") == [("framework", None, "site/.vitepress/./theme/y")]


def test_runtime_entries(spark):
    packages = {
        ("r", ""): {"scripts": {"start": "node dist/server.js", "dev": "wrangler dev w.ts"}, "dependencies": {"next": "1"}},
        ("r", "site"): {"devDependencies": {"vitepress": "1"}},
        ("s", "web"): {"scripts": {"p": "wrangler pages dev"}},
        ("t", ""): {},
        ("u", ""): {"scripts": {"d": "wrangler deploy other.ts"}},
    }
    files = {
        ("r", "src/server.ts"): None, ("r", "w.ts"): None, ("r", "pages/a.tsx"): None, ("r", "pages/a.test.tsx"): None, ("r", "pages/b.d.ts"): None, ("r", "src/app/c.ts"): None, ("r", "lib/x.ts"): None,
        ("r", "site/pages/no.ts"): None, ("r", "site/docs/.vitepress/config.ts"): "import './theme/z'", ("r", "site/docs/.vitepress/theme/z.ts"): None, ("r", "site/docs/.vitepress/cache/q.js"): None, ("r", "site/x/y.data.js"): None, ("r", "site/.h/k.data.js"): None,
        ("s", "web/functions/f.ts"): None, ("s", "web/netlify/functions/g.js"): None, ("s", "functions/h.ts"): None, ("s", "web/api/i.ts"): None,
        ("t", "index.html"): '<script src="./dist/main.js"></script><script src="src/p.ts"></script>', ("t", "webpack.config.js"): "module.exports = {}", ("t", "src/index.ts"): None, ("t", "src/p.ts"): None, ("t", "Dockerfile"): "CMD node build/run.js", ("t", "src/run.ts"): None,
        ("u", "wrangler.toml"): 'main = "src/worker.js"', ("u", "src/worker.ts"): None, ("u", "other.ts"): None, ("u", "vercel.json"): None, ("u", "api/v.ts"): None,
    }
    manifests = spark.createDataFrame([(r, d, json.dumps(m)) for (r, d), m in packages.items()], "repo string, dir string, text string")
    e = RuntimeEntries(manifests, spark.createDataFrame([(r, p, t) for (r, p), t in files.items()], "repo string, path string, text string"))
    got = {(r["repo"], r["dir"], r["file"], r["what"]) for r in e.runtime.collect()}
    assert got == {
        ("r", "", "src/server.ts", "script"), ("r", "", "w.ts", "script"), ("r", "", "pages/a.tsx", "Next.js"), ("r", "", "src/app/c.ts", "Next.js"),
        ("r", "site", "site/docs/.vitepress/config.ts", "VitePress"), ("r", "site", "site/docs/.vitepress/theme/z.ts", "VitePress"), ("r", "site", "site/docs/.vitepress/theme/z.ts", "framework"), ("r", "site", "site/x/y.data.js", "VitePress"),
        ("s", "web", "web/functions/f.ts", "Cloudflare Pages Functions"), ("s", "web", "web/netlify/functions/g.js", "Netlify Functions"),
        ("t", "", "src/index.ts", "webpack"), ("t", "", "src/index.ts", "page"), ("t", "", "src/p.ts", "page"), ("t", "", "src/run.ts", "image"),
        ("u", "", "src/worker.ts", "worker"), ("u", "", "api/v.ts", "Vercel Functions"),
    }

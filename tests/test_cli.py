import glob
import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_cli_snapshots_a_folder():
    base = tempfile.mkdtemp(prefix="snapweave-cli-")
    proj = os.path.join(base, "proj")
    os.makedirs(os.path.join(proj, "src"))
    with open(os.path.join(proj, "src", "main.py"), "w") as fh:
        fh.write("print('hi')\n")
    with open(os.path.join(proj, "debug.log"), "w") as fh:
        fh.write("x\n")
    out = os.path.join(base, "out")
    res = subprocess.run([sys.executable, "-m", "snapweave", proj, "--out", out], cwd=REPO,
                         capture_output=True, text=True, timeout=600)
    assert res.returncode == 0, res.stderr[-2000:]
    assert '"repo": "proj"' in res.stdout and '"text_files": 1' in res.stdout
    doc = "".join(open(p, encoding="utf-8").read()
                  for p in sorted(glob.glob(f"{out}/documents/repo=proj/part-*")))
    assert "Project: proj" in doc and "/* ===== src/main.py ===== */\nprint('hi')\n" in doc
    assert "/* debug.log */" in doc

"""Worker-side helpers travel by value: executors need not have the package installed."""

import base64
import subprocess
import sys


def test_pair_helper_unpickles_without_the_package(tmp_path):
    from pyspark import cloudpickle

    from cartflow.operators import baskets as B

    blob = base64.b64encode(cloudpickle.dumps(B._pair_rows)).decode()
    code = (
        "import base64, sys, pandas as pd\n"
        "sys.path = [p for p in sys.path if 'repo' not in p]\n"
        "import pickle\n"
        f"f = pickle.loads(base64.b64decode('{blob}'))\n"
        "x = next(f([pd.DataFrame({'items': [[1, 2, 3], [1, 2]]})]))\n"
        "print(int(x.n.sum()), x.shape)\n"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert out.stdout.strip() == "4 (3, 3)"

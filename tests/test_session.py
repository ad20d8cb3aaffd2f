"""The shared folder where no setting names one."""

import os
import subprocess
import sys

CODE = """
from sonaril.session import local_session, shared_folder
spark = local_session(1, 1)
assert spark.conf.get("spark.checkpoint.dir", None) is None
a = shared_folder(spark)
assert a.startswith("file:///tmp/") and shared_folder(spark) == a
spark.range(3).write.parquet(a + "/t")
assert spark.read.parquet(a + "/t").count() == 3
print("fine")
"""


def test_shared_folder_without_a_setting(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if not k.startswith("SPARK_")} | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, timeout=240)
    assert done.stdout.strip() == "fine", done.stderr[-2000:]

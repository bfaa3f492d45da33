import json
import os
import sys

import pytest
import yaml
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from layouts import CONFIG  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("loomtrace-tests")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.sql.codegen.wholeStage", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def design(tmp_path):
    """Write libraries and config, return a function that gives the runset path of a cell."""
    def write(libs: dict, lib: str, cell: str, config: dict | None = None, log_dir: str | None = None) -> str:
        db = tmp_path / "db"
        db.mkdir(exist_ok=True)
        for name, cells in libs.items():
            (db / f"{name}_db.json").write_text(json.dumps({name: cells}))
        config_path = tmp_path / "config.yaml"
        config_path.write_text(yaml.safe_dump(CONFIG if config is None else config))
        runset = tmp_path / f"{lib}_{cell}.yaml"
        runset.write_text(yaml.safe_dump({
            "libname": lib, "cellname": cell, "db_dir": str(db), "log_dir": str(log_dir or tmp_path / "log"),
            "metal_dir": "m", "via_dir": "v", "visualized_dir": "x", "netlog_dir": "n",
            "config_file_path": str(config_path),
        }))
        return str(runset)
    return write

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from tracelake.session import configure

    session = (
        SparkSession.builder.master("local[8]")
        .appName("tracelake-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tracelake-tests-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


# a spraying vehicle: five rows, one of them low on charge and blocked
SENSOR_CSV = (
    "t,gyro_x,gyro_y,gyro_z,battery,mode,severity,msg\n"
    "10,1.5,-0.2,0.7,0.81,IDLE,INFO,pump primed\n"
    "12,1.1,-0.1,0.9,0.64,IDLE,INFO,valve two open\n"
    "15,0.4,0.3,0.8,0.33,SPRAY,WARN,pressure below plan\n"
    "19,0.9,0.2,0.6,0.12,HALT,ERROR,nozzle blocked\n"
    "23,1.0,0.1,0.5,0.40,IDLE,INFO,rinse done\n"
)
SENSOR_JSONL = (
    '{"time": 5, "fuel": 40.5, "mode": "PARK", "arm": {"x": 1.5, "y": 2.0, "z": 0.5}, "severity": "INFO", "msg": "arm folded"}\n'
    '{"time": 8, "fuel": 39.0, "mode": "DRIVE", "arm": {"x": 1.5, "y": 2.5, "z": 0.5}, "severity": "WARN", "msg": "wheel slip"}\n'
    "\n"
    '{"time": 9, "fuel": 37.5, "mode": "PARK", "arm": {"x": 1.0, "y": 2.5, "z": 1.0}, "severity": "ERROR", "msg": "ERROR no fix"}\n'
)


@pytest.fixture
def sensor_csv(tmp_path):
    path = tmp_path / "sprayer.csv"
    path.write_text(SENSOR_CSV, encoding="utf-8")
    return str(path)


@pytest.fixture
def sensor_jsonl(tmp_path):
    path = tmp_path / "sprayer.jsonl"
    path.write_text(SENSOR_JSONL, encoding="utf-8")
    return str(path)

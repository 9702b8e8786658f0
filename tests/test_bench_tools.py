import json
import os

from bench import shuffle_bytes


def test_shuffle_bytes_sums_per_job_group(tmpdir_path):
    events = [
        {"Event": "SparkListenerJobStart", "Stage IDs": [1, 2], "Properties": {"spark.jobGroup.id": "q1"}},
        {"Event": "SparkListenerJobStart", "Stage IDs": [3], "Properties": {"spark.jobGroup.id": "q2"}},
        {"Event": "SparkListenerTaskEnd", "Stage ID": 1, "Task Metrics": {"Shuffle Write Metrics": {"Shuffle Bytes Written": 10}}},
        {"Event": "SparkListenerTaskEnd", "Stage ID": 2, "Task Metrics": {"Shuffle Write Metrics": {"Shuffle Bytes Written": 5}}},
        {"Event": "SparkListenerTaskEnd", "Stage ID": 3, "Task Metrics": {}},
    ]
    os.makedirs(os.path.join(tmpdir_path, "app"))
    with open(os.path.join(tmpdir_path, "app", "events"), "w") as f:
        f.write("\n".join(json.dumps(e) for e in events) + "\n")
    assert shuffle_bytes(tmpdir_path) == {"q1": 15, "q2": 0}

import re
import subprocess
import sys

FREED = """
import re
import numpy as np
import pyarrow as pa
from loomwork.llm.common import {name}

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024

def each(batches):
    for batch in batches:
        some = [np.ones(60_000, np.uint8) for _ in range(4000)]  # 240 MB
        last = np.ones(60_000, np.uint8)  # keeps the end of the heap
        del some
        yield batch.slice(0, len(last[:1]))
    kept.append(last)

kept, was = [], held()
list({call}(iter([pa.RecordBatch.from_arrays([pa.array([1])], ["x"])])))
print(held() - was)
"""


def test_freed_memory_of_a_task_goes_back_to_the_system():
    code = FREED.format(name="lean", call="lean(each)")
    assert int(subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, text=True).stdout) < 60
    if sys.platform == "linux":  # without it the allocator keeps most
        code = FREED.format(name="mix", call="each")
        assert int(re.search(r"-?\d+", subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, text=True).stdout)[0]) > 100

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_works_without_the_training_data_operators(tmp_path):
    shutil.copytree(ROOT / "loomtext", tmp_path / "loomtext", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'collocations_bigram_pmi' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_all_are_registered():
    if not (ROOT / "loomtext/llm").exists():
        return
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' in q and all(sum(k.startswith(f'op{n}_') for k in q) == 1 for n in range(1, 11))"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)

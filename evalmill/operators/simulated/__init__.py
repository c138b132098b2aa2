"""All simulated services by name."""

from evalmill.operators.simulated.core import Service
from evalmill.operators.simulated.files import files
from evalmill.operators.simulated.maths import maths
from evalmill.operators.simulated.memory import memory_kv, memory_text, memory_vector
from evalmill.operators.simulated.social import messages, posts, tickets
from evalmill.operators.simulated.trading import trading
from evalmill.operators.simulated.travel import travel
from evalmill.operators.simulated.vehicle import vehicle

SERVICES: dict[str, Service] = {"files": files, "maths": maths, "messages": messages, "posts": posts, "tickets": tickets, "trading": trading, "travel": travel, "vehicle": vehicle, "memory_kv": memory_kv, "memory_vector": memory_vector, "memory_text": memory_text}

"""The built-in rule layers."""

from __future__ import annotations

from palimpsest.operators.rules import DEFAULTS, PRESET, PROJECT, USER, Config, RuleSet, assemble

# Which paths, commands and patterns the built-in layers restrict.
BUILTIN = Config(
    block=(
        "~/.ssh/id_*",
        "~/.ssh/known_hosts",
        "~/.gnupg/**",
        "~/.password-store/**",
        "~/.local/share/pass/**",
        "~/.config/bitwarden/**",
        "~/.git-credentials",
        "~/.config/gh/hosts.yml",
        "/etc/shadow",
        "/etc/gshadow",
    ),
    local_only=(
        "~/.envrc",
        "**/.env",
        "**/.env.*",
        "**/credentials*",
        "**/secret*",
        "~/.config/himalaya/**",
        "~/.thunderbird/**",
        "~/Documents/finances/**",
        "~/Documents/taxes/**",
        "~/Documents/medical/**",
        "/etc/letsencrypt/**",
        "~/.config/chromium/Cookies",
        "~/.config/chromium/History",
        "~/.config/chromium/Login Data",
        "~/.mozilla/firefox/**/cookies.sqlite",
        "~/.mozilla/firefox/**/places.sqlite",
    ),
    redact=(
        "~/.zsh_history",
        "~/.bash_history",
        "~/.local/share/fish/history",
        "/var/log/nginx/access.log",
        "/var/log/nginx/error.log",
        "/var/log/auth.log",
        "/var/log/syslog",
        "ps aux",
        "ss -tlnp",
    ),
    patterns=dict.fromkeys(
        (
            "ipv4",
            "ipv6",
            "email",
            "phone",
            "api_key_github",
            "api_key_openai",
            "api_key_anthropic",
            "api_key_aws",
            "api_key_google",
            "api_key_stripe",
            "jwt",
            "private_key",
            "mac_address",
            "credit_card",
            "syslog_hostname",
            "passwd_username",
        ),
        True,
    ),
)

DESKTOP = Config(
    redact=(
        "~/.config/discord/*",
        "~/.config/Slack/*",
        "~/.config/Code/*",
        "~/.config/obsidian/*",
        "~/.config/TelegramDesktop/*",
    ),
    local_only=(
        "~/Pictures/*.jpg",
        "~/Pictures/*.png",
        "~/Pictures/*.heic",
        "~/Pictures/*.JPG",
        "~/Pictures/*.PNG",
        "~/Downloads/*.pdf",
        "~/Downloads/*.docx",
        "~/Documents/Obsidian/**",
    ),
    block=("~/.config/Signal/**", "~/.config/WireGuard/**"),
)

SERVER = Config(
    block=(
        "/etc/ssl/private/*",
        "/etc/bind/rndc.key",
        "/root/.ssh/*",
        "/home/*/.ssh/id_*",
        "/etc/postgresql/*/main/pg_hba.conf",
        "/etc/mysql/my.cnf",
        "/etc/redis/redis.conf",
        "/etc/tailscale/tailscaled.state",
        "/etc/restic/*",
    ),
    local_only=(
        "/var/log/**",
        "/tmp/*.sql",
        "/var/backups/**",
        "~/.local/share/*/dumps/*",
        "/var/mail/*",
        "/var/vmail/**",
        "/home/*/mail/*",
        "/home/*/Maildir/**",
    ),
    redact=(
        "/etc/nginx/sites-enabled/*",
        "/etc/nginx/sites-available/*",
        "/etc/apache2/sites-enabled/*",
        "/etc/caddy/Caddyfile",
        "/etc/haproxy/haproxy.cfg",
        "**/docker-compose.yml",
        "**/docker-compose.yaml",
        "**/compose.yml",
        "/etc/cron.d/*",
        "/etc/crontab",
        "/var/spool/cron/**",
    ),
    commands=(
        ("journalctl -u *", "redact"),
        ("journalctl --since *", "redact"),
        ("journalctl --since * --until *", "redact"),
        ("docker logs *", "redact"),
        ("ps aux", "redact"),
        ("ps -ef", "redact"),
        ("ss -tlnp", "redact"),
        ("ss -tulnp", "redact"),
        ("netstat -tlnp", "redact"),
        ("mysql *", "local-only"),
        ("psql *", "local-only"),
        ("sqlite3 *", "local-only"),
        ("redis-cli *", "local-only"),
        ("cat /etc/shadow", "block"),
        ("cat /etc/gshadow", "block"),
        ("cat ~/.ssh/id_*", "block"),
        ("cat /root/.ssh/id_*", "block"),
    ),
    patterns=dict.fromkeys(("ipv4_private", "hostname_internal", "database_connection"), True),
)

PARANOID = Config(
    block=("**/*credential*", "**/*secret*", "**/*password*", "**/*token*", "**/*api_key*", "**/*apikey*"),
    local_only=("/var/log/**", "~/.local/state/**", "/var/lib/**", "/etc/**", "~/.config/**", "~/**"),
    redact=("~/projects/*/README.md", "~/projects/*/.gitignore", "~/projects/*/Makefile"),
    patterns=dict.fromkeys(
        (
            "ipv4",
            "ipv6",
            "ipv4_private",
            "email",
            "phone",
            "api_key_github",
            "api_key_openai",
            "api_key_anthropic",
            "api_key_aws",
            "api_key_google",
            "api_key_stripe",
            "jwt",
            "private_key",
            "mac_address",
            "credit_card",
            "hostname_internal",
            "database_connection",
            "ssn_us",
            "iban",
            "passport",
        ),
        True,
    ),
)

TRAINING_DATA = Config(
    block=(
        "**/.env",
        "**/.env.*",
        "**/credentials*",
        "**/secret*",
        "**/*api_key*",
        "**/*apikey*",
        "**/*.pem",
        "**/*.key",
        "~/.ssh/*",
        "~/.gnupg/*",
        "~/.password-store/*",
        "~/.git-credentials",
    ),
    local_only=(
        "**/config/database.yml",
        "**/config/secrets.yml",
        "**/.vscode/settings.json",
        "**/docker-compose.yml",
        "**/docker-compose.yaml",
    ),
    redact=(
        "**/*.py",
        "**/*.js",
        "**/*.ts",
        "**/*.go",
        "**/*.rs",
        "**/*.java",
        "**/*.rb",
        "**/*.sh",
        "**/*.yaml",
        "**/*.yml",
        "**/*.json",
        "**/*.toml",
        "**/*.xml",
        "**/*.sql",
        "**/*.csv",
        "**/*.md",
        "**/*.txt",
        "**/*.rst",
        "**/*.log",
        "**/*.jsonl",
        "**/*.parquet",
        "**/*.tsv",
    ),
    patterns=dict.fromkeys(
        (
            "ipv4",
            "ipv6",
            "ipv4_private",
            "email",
            "phone",
            "api_key_github",
            "api_key_openai",
            "api_key_anthropic",
            "api_key_aws",
            "api_key_google",
            "api_key_stripe",
            "api_key_slack",
            "api_key_gitlab",
            "bearer_token",
            "jwt",
            "private_key",
            "mac_address",
            "credit_card",
            "ssn_us",
            "database_connection",
            "hostname_internal",
            "iban",
            "passport",
            "high_entropy_secret",
        ),
        True,
    ),
)

PRESETS = {"desktop": DESKTOP, "server": SERVER, "paranoid": PARANOID, "training-data": TRAINING_DATA}
# End of fixed values.


def choose_preset(requested: str = "", user: Config | None = None, project: Config | None = None) -> str:
    """The explicitly requested preset, else the user's, else the project's, else desktop."""
    name = (requested or (user.preset if user else "") or (project.preset if project else "") or "desktop").strip()
    if name not in PRESETS:
        raise ValueError(f"unknown preset: {name}")
    return name


def load_rules(
    preset: str = "", user: Config | None = None, project: Config | None = None, home: str = "/root"
) -> RuleSet:
    """The rule set of the built-in defaults, a preset, and the user's and project's own layers."""
    name = choose_preset(preset, user, project)
    layers = [(DEFAULTS, "defaults", BUILTIN), (PRESET, f"preset:{name}", PRESETS[name])]
    layers += [(USER, "user", user)] if user else []
    layers += [(PROJECT, "project", project)] if project else []
    return assemble(layers, home)

"""Plain versions of what the queries return, for comparison."""
import re, hashlib, collections
def words(t): return re.findall(r"[^\x20\x09-\x0D]+", t or "")
def lower(t): return re.sub(r"[A-Z]", lambda m:m[0].lower(), t or "")
def op7(t):
    t=t or ""
    A=[(m.start(),m.end()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",t,re.ASCII) if len(m[1])>=6]
    K=[(m.start(),m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+",t) if len(m[0])>=20]
    H=[(m.start(),m.end()) for m in re.finditer(r"[0-9a-f]+",t) if len(m[0])>=24]
    al=sorted([(s,i,e) for i,x in enumerate((A,K,H)) for s,e in x])
    return len(A),len(K),len(H),hashlib.sha256(",".join(f"{['assign','access','hex'][i]}:{s}:{e}" for s,i,e in al).encode()).hexdigest()
def op8(t):
    t=t or ""; w=words(t); n=len(w)
    sym=sum(t.count(c) for c in "#*$%&|<>")
    seen=set(); dup=0
    for l in t.split("\n"):
        if words(l):
            dup+= l in seen; seen.add(l)
    g=[tuple(w[i:i+8]) for i in range(n-7)]; c=collections.Counter(g); cov=[0]*n
    for i,x in enumerate(g):
        if c[x]>1: cov[i:i+8]=[1]*8
    r=sum(cov)
    return n,sum(map(len,w)),sym,dup,r,(n<20 or 100*r>30*n)
def w9(t): return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
def op9(docs,bench):
    win=collections.defaultdict(set); L=set()
    for i,t in bench:
        w=w9(t)
        if not w: continue
        k=min(13,len(w)); L.add(k)
        for j in range(len(w)-k+1): win[tuple(w[j:j+k])].add(i)
    out=[]
    for d,t in docs:
        w=w9(t); hit=[0]*len(w); it=set()
        for k in L:
            for j in range(len(w)-k+1):
                x=win.get(tuple(w[j:j+k]))
                if x: it|=x; hit[j:j+k]=[1]*k
        h=sum(hit); it=sorted(str(x) for x in it if x is not None)
        out.append((d,len(w),h,len(it),hashlib.sha256(",".join(it).encode()).hexdigest(),h>0 and 20*h>=len(w)))
    return out
def lev(a,b,k):
    if abs(len(a)-len(b))>k: return k+1
    p=list(range(len(b)+1))
    for i,x in enumerate(a,1):
        q=[i]
        for j,y in enumerate(b,1): q.append(min(p[j]+1,q[-1]+1,p[j-1]+(x!=y)))
        if min(q)>k: return k+1
        p=q
    return p[-1]
def op5(docs):
    first={}
    D=sorted(((d,(t or "").encode()) for d,t in docs))
    for d,b in D:
        for i in range(len(b)-49): first.setdefault(b[i:i+50],d)
    out={}
    for d,b in D:
        cov=bytearray(len(b))
        for i in range(len(b)-49):
            if first[b[i:i+50]]<d: cov[i:i+50]=b"\1"*50
        kept=bytes(x for x,c in zip(b,cov) if not c); spans=len(re.findall(b"\1+",bytes(cov)))
        out[d]=(len(b),sum(cov),spans,hashlib.sha256(kept).hexdigest())
    return out
